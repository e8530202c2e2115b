"""Buckets of a table whose days are replaced, from the stream that follows its change log."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from sessionscope.operators.sessions import SESSION
from sessionscope.session import scratch_dir
from sessionscope.sources.sinks import replace_date_range
from sessionscope.streaming.rollups import contributions, follow, log_stored, purchased_sessions, read_rollup

SCHEMA = f"event_timestamp string, user_prop_default_branch_id string, {SESSION} string, revenue decimal(15,2), tenant_id string, event_date date"


def rows_of(frame):
    return sorted(((r.tenant_id, r.event_date.day, r.hour_start and r.hour_start.hour, r[SESSION], r.events, float(r.revenue)) for r in frame.collect()), key=str)


def test_replaced_halved_and_emptied_days(spark):
    root = scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True)
    d = lambda n: dt.date(2024, 1, n)
    at = lambda n, hour: str(int(dt.datetime(2024, 1, n, hour, 30, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)
    frame = lambda rows: spark.createDataFrame([(*r[:3], dt_dec(r[3]), *r[4:]) for r in rows], SCHEMA)
    import decimal
    dt_dec = decimal.Decimal
    first = [(at(1, 3), "D1", "s1", 5, "T0", d(1)), (at(1, 3), "D1", "s1", 7, "T0", d(1)), ("no time", "D1", "s2", 1, "T0", d(1)), (at(2, 4), "D1", None, 2, "T0", d(2)), (at(2, 4), "D1", "s9", 2, "T1", d(2))]

    def follow_up():
        follow(spark, f"{root}/purchase", frame([]).schema, f"{root}/rollup", f"{root}/checkpoint", "revenue").awaitTermination()
        return rows_of(read_rollup(spark, f"{root}/rollup"))

    def expected():
        return rows_of(contributions(spark.read.schema(SCHEMA).parquet(f"{root}/purchase"), "revenue"))

    frame(first).write.partitionBy("tenant_id", "event_date").parquet(f"{root}/purchase")
    log_stored(spark, f"{root}/purchase")
    assert follow_up() == expected() == [("T0", 1, 3, "s1", 2, 12.0), ("T0", 1, None, "s2", 1, 1.0), ("T0", 2, 4, None, 1, 2.0), ("T1", 2, 4, "s9", 1, 2.0)]
    replace_date_range(spark, f"{root}/purchase", None, "2024-01-01", "2024-01-02", frame(first))
    replace_date_range(spark, f"{root}/purchase", "T0", "2024-01-01", "2024-01-02", frame(first[:1]))
    assert follow_up() == expected() == [("T0", 1, 3, "s1", 1, 5.0), ("T1", 2, 4, "s9", 1, 2.0)]
    assert follow_up() == expected()
    found = purchased_sessions(read_rollup(spark, f"{root}/rollup"))
    assert sorted(map(tuple, found.collect())) == [("T0", "s1"), ("T1", "s9")]
    assert found.filter(F.col(SESSION).isNull()).isEmpty()
