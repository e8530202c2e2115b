"""ST2 for tables whose days are replaced: Q2's buckets kept up by a stream, in all six granularities.

A file stream over an event table cannot take a replaced day back: it sees the new files as more rows. The stream here
follows the table's change log instead (``sinks.changes_path``): the (tenant, day) pairs that a replace wrote or emptied. For
each of them the day's contribution -- one row a (branch, hour, session) with its events and revenue -- is computed again
from the table and replaces the day's old contribution, which so is subtracted from every window it was part of. A pair
that is logged twice, or replayed, is only computed again.

Contributions add up over days: event and revenue sums directly, sessions as a distinct count over the sessions that the
contributions name. Every window of every granularity comes from them, and so does the set of sessions with a purchase (J2).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.timebucket import is_digits, micros_to_ts
from sessionscope.operators.sessions import SESSION
from sessionscope.plans.chart import chart_from_parts, rolled_parts
from sessionscope.session import delete_path, scratch_dir
from sessionscope.sources.sinks import PAIR, PAIR_SCHEMA, changes_path, replace_pairs, stored_pairs

#: The event tables of Q2 and the value that each one sums.
CHART_TABLES = {"purchase": "ecommerce_purchase_revenue", "page_view": None, "add_to_cart": None, "view_search_results": None, "no_search_results": None}
CONTRIBUTION_SCHEMA = f"hour_start timestamp, user_prop_default_branch_id string, {SESSION} string, events bigint, revenue decimal(38,2), {PAIR_SCHEMA}"


def contributions(events: DataFrame, value: str | None = None) -> DataFrame:
    """What each (tenant, day) adds: events (and summed ``value``) by hour, branch and session. An hour is NULL where the timestamp is no time."""
    hour = F.when(is_digits(F.col("event_timestamp")), F.date_trunc("hour", micros_to_ts(F.col("event_timestamp"))))
    revenue = F.sum(value) if value else F.lit(None)
    return (events.groupBy(*PAIR, hour.alias("hour_start"), "user_prop_default_branch_id", SESSION)
            .agg(F.count(F.lit(1)).alias("events"), revenue.cast("decimal(38,2)").alias("revenue"))
            .select("hour_start", "user_prop_default_branch_id", SESSION, "events", "revenue", *PAIR))


def log_stored(spark: SparkSession, table_path: str) -> None:
    """Log every stored pair of a table that was not written by a replace, so that a stream takes it in."""
    stored_pairs(spark, table_path).write.mode("append").parquet(changes_path(table_path))


def follow(spark: SparkSession, table_path: str, schema, rollup_path: str, checkpoint: str, value: str | None = None,
           max_files_per_trigger: int | None = None):
    """Bring the contributions of an event table up to its change log (``availableNow``); returns the StreamingQuery."""
    reader = spark.readStream.schema(PAIR_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def batch(changed: DataFrame, batch_id: int) -> None:
        scratch = scratch_dir(spark, f"rollup-{uuid.uuid4().hex}", temporary=True)
        changed.distinct().write.parquet(f"{scratch}/pairs")
        pairs = spark.read.schema(PAIR_SCHEMA).parquet(f"{scratch}/pairs")
        first, last = pairs.agg(F.min("event_date"), F.max("event_date")).first()
        if first is not None:
            between = F.col("event_date").between(F.lit(first), F.lit(last))
            events = spark.read.schema(schema).parquet(table_path).filter(between).join(pairs, PAIR, "left_semi")
            contributions(events, value).hint("rebalance", *PAIR).write.partitionBy(*PAIR).parquet(f"{scratch}/new")
            staged = spark.read.schema(CONTRIBUTION_SCHEMA).parquet(f"{scratch}/new")
            replace_pairs(spark, rollup_path, staged, lambda stored: stored.filter(between).join(pairs, PAIR, "left_semi"))
        delete_path(spark, scratch)

    return (reader.parquet(changes_path(table_path)).writeStream.foreachBatch(batch)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_rollup(spark: SparkSession, rollup_path: str) -> DataFrame:
    return spark.read.schema(CONTRIBUTION_SCHEMA).parquet(rollup_path)


def rolled_chart(rollups: dict[str, DataFrame], start: str | None, end: str | None, granularity: str | None,
                 tenant_id: str | None = None, location_id: str | None = None) -> DataFrame:
    """Q2 from contributions by table name (``CHART_TABLES``); equal to ``chart_data`` over the tables that they follow."""
    return chart_from_parts(rollups["purchase"].sparkSession, lambda g: rolled_parts(rollups, start, end, g, tenant_id, location_id), start, end, granularity, tenant_id)


def purchased_sessions(purchases: DataFrame) -> DataFrame:
    """(tenant, session) with a purchase at any time, from the contributions of the purchase table."""
    return purchases.select("tenant_id", SESSION).filter(F.col(SESSION).isNotNull()).distinct()
