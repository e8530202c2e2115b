"""The ingest run under failures and several tenants, the replace's change log, and what a re-ingest trigger reads."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from sessionscope.session import scratch_dir
from sessionscope.sources.extract import EVENT_NAMES, extract_all, extract_events, extract_table, reclassified, reclassify_search_events, table_view
from sessionscope.sources.fixtures import load_tables
from sessionscope.sources.ingest import run_ingest, stage_events, staged_table
from sessionscope.sources.sinks import changes_path, replace_date_range
from sessionscope.streaming.reingest import current_exports, incremental_reingest, index_path

SF = "/root/testdata/sf0.001"
RANGE = ("2024-01-02", "2024-01-04")


@pytest.fixture(scope="module")
def raw(spark):
    from sessionscope.sources.raw import raw_events
    return raw_events(load_tables(spark, SF).base)


@pytest.fixture
def root(spark):
    return scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True)


def by_type(run):
    return {r.data_type: r.records for r in run.summary.groupBy("data_type").agg(F.sum("records").alias("records")).collect()}


def loaded(spark, raw):
    tables = reclassify_search_events(extract_all(raw, *RANGE))
    return {t: rows.count() for t, rows in tables.items()}


def test_one_pass_equals_the_six_extracts(spark, raw, root):
    staged, failed = stage_events(raw, *RANGE, f"{root}/staging")
    assert not failed
    for name, rows in reclassify_search_events(extract_all(raw, *RANGE)).items():
        want = rows.drop("raw_data")
        got = staged_table(staged, name)
        assert got.columns == want.columns
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = reclassified(extract_events(raw, *RANGE))._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in x and "/events.parquet" in x for x in plan.splitlines()) == 1 and "Exchange" not in plan.replace("BroadcastExchange", "")
    one = extract_events(raw, *RANGE)
    assert table_view(one, "purchase").select("items_json").exceptAll(extract_table(raw, "purchase", *RANGE).select("items_json")).isEmpty()


def test_a_corrupt_file_leaves_the_other_types_loaded(spark, raw, root, tmp_path):
    """The export is laid out by event name; the file of one name is no Parquet."""
    raw.write.partitionBy("event_name").parquet(f"{tmp_path}/raw")
    folder = f"{tmp_path}/raw/event_name=purchase"
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", "wb") as file:
            file.write(b"this is no parquet file")
    landed = spark.read.schema(raw.schema).parquet(f"{tmp_path}/raw")
    run = run_ingest(spark, root, *RANGE, landed, data_types=("events",))
    assert list(run.failed) == ["purchase"] and run.failed["purchase"]
    want = loaded(spark, raw) | {"purchase": 0}
    assert {t: n for t, n in by_type(run).items() if t in EVENT_NAMES} == want


def test_a_storage_error_leaves_the_other_types_loaded(spark, raw, root, tmp_path):
    """A plain file stands where one table's folder should be."""
    warehouse = str(tmp_path / "warehouse")
    os.makedirs(warehouse)
    with open(f"{warehouse}/view_item", "w") as file:
        file.write("x")
    run = run_ingest(spark, warehouse, *RANGE, raw, data_types=("events",))
    assert list(run.failed) == ["view_item"]
    assert {t: n for t, n in by_type(run).items() if t in EVENT_NAMES} == loaded(spark, raw) | {"view_item": 0}


def test_a_failing_python_function_leaves_the_other_types_loaded(spark, raw, root):
    @F.udf("string")
    def broken(x):
        raise ValueError("no title")
    rows = extract_table(raw, "purchase", *RANGE).withColumn("param_page_title", broken("param_page_title"))
    run = run_ingest(spark, root, *RANGE, raw, extracted={"purchase": rows}, data_types=("events",))
    assert list(run.failed) == ["purchase"] and run.failed["purchase"]
    assert {t: n for t, n in by_type(run).items() if t in EVENT_NAMES} == loaded(spark, raw) | {"purchase": 0}


def test_a_row_that_fails_in_the_shared_scan(spark, raw, root):
    """The bad row is of one event name; the types are then scanned one by one."""
    bad = raw.withColumn("user_pseudo_id", F.when(F.col("event_name") == "add_to_cart", F.raise_error(F.lit("bad row")).cast("string")).otherwise(F.col("user_pseudo_id")))
    run = run_ingest(spark, root, *RANGE, bad, data_types=("events",))
    assert list(run.failed) == ["add_to_cart"] and "bad row" in run.failed["add_to_cart"]
    assert {t: n for t, n in by_type(run).items() if t in EVENT_NAMES} == loaded(spark, raw) | {"add_to_cart": 0}


def test_nothing_can_be_staged(spark, raw, root):
    bad = raw.withColumn("user_pseudo_id", F.raise_error(F.lit("bad row")).cast("string"))
    run = run_ingest(spark, root, *RANGE, bad, data_types=("events",))
    assert sorted(run.failed) == sorted(EVENT_NAMES) and run.summary.collect() == []


def test_two_runs_count_their_own_tenants(spark, raw, root):
    first = run_ingest(spark, root, *RANGE, raw.filter("tenant_id = 'T0'"), data_types=("events",))
    second = run_ingest(spark, root, *RANGE, raw.filter("tenant_id = 'T1'"), data_types=("events",))
    assert {r.tenant_id for r in first.summary.collect()} == {"T0"}
    assert {r.tenant_id for r in second.summary.collect()} == {"T1"}
    assert {t: by_type(first)[t] + by_type(second)[t] for t in EVENT_NAMES} == loaded(spark, raw)


def test_a_replace_logs_replaced_and_emptied_pairs(spark, root):
    import datetime as dt
    d = lambda n: dt.date(2024, 1, n)
    frame = lambda rows: spark.createDataFrame(rows, "tenant_id string, event_date date, v long")
    path = f"{root}/table"
    log = lambda: sorted((r.tenant_id, r.event_date.day) for r in spark.read.parquet(changes_path(path)).collect())
    replace_date_range(spark, path, None, "2024-01-01", "2024-01-03", frame([("T0", d(1), 1), ("T0", d(2), 2), ("T1", d(2), 3)]))
    assert log() == [("T0", 1), ("T0", 2), ("T1", 2)]
    replace_date_range(spark, path, "T0", "2024-01-01", "2024-01-03", frame([("T0", d(2), 20)]))
    assert log() == [("T0", 1), ("T0", 1), ("T0", 2), ("T0", 2), ("T1", 2)]
    assert sorted((r.tenant_id, r.event_date.day, r.v) for r in spark.read.parquet(path).collect()) == [("T0", 2, 20), ("T1", 2, 3)]


def test_a_trigger_reads_only_the_files_of_touched_pairs(spark, raw, root):
    day = lambda n: raw.filter(F.col("event_date") == f"2024010{n}")
    catch_up = lambda: incremental_reingest(spark, f"{root}/landing", f"{root}/wh", f"{root}/ckpt", raw_schema=raw.schema).awaitTermination()
    for number, n in enumerate((2, 3, 4, 5), 1):
        day(n).repartition(2).write.parquet(f"{root}/landing/export_id={number}")
    catch_up()
    day(3).coalesce(1).write.parquet(f"{root}/landing/export_id=9")
    catch_up()
    index = spark.read.parquet(index_path(f"{root}/ckpt"))
    batches = sorted(r[0] for r in index.select("batch").distinct().collect())
    assert len(batches) == 2 and index.select("file").distinct().count() == 9
    of = lambda b: {r["file"] for r in current_exports(index, b).select("file").distinct().collect()}
    assert len(of(batches[1])) == 1 and all("export_id=9" in f for f in of(batches[1]))
    stored = spark.read.schema("tenant_id string, event_date date, event_id long").parquet(f"{root}/wh/page_view")
    want = raw.filter("event_name = 'page_view' and event_date between '20240102' and '20240105'").count()
    assert stored.count() == want
