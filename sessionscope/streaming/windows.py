"""ST2: Q2's buckets as tumbling event-time windows on a stream.

Flat events stream in (file source); ``update`` mode emits the windows a micro-batch
changed. The sink appends them to a change-log table with the batch id;
``compact_changelog`` reads the latest version of every window -- a grouped
``max_by``, no single-task step.

By default no event is dropped, however late: the state holds one count a (tenant, window)
and a backfill may be read in any number of batches and in any order. A ``watermark``
bounds that state for an endless live stream; then events later than it are dropped, and
the query's progress reports how many (``numRowsDroppedByWatermark``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.timebucket import micros_to_ts, is_digits


def windowed_counts(events: DataFrame, window: str = "4 hours", watermark: str | None = None,
                    value_col: str | None = None) -> DataFrame:
    """Tumbling-window event counts (and summed ``value_col``) per tenant."""
    ev = events.filter(is_digits(F.col("event_timestamp"))).withColumn(
        "event_ts", micros_to_ts(F.col("event_timestamp")))
    aggs, out = [F.count(F.lit(1)).alias("events")], ["events"]
    if value_col:
        aggs.append(F.sum(value_col).alias("value"))
        out.append("value")
    return ((ev.withWatermark("event_ts", watermark) if watermark else ev)
            .groupBy("tenant_id", F.window("event_ts", window).alias("w"))
            .agg(*aggs)
            .select("tenant_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out))


def start_windowed_stream(spark: SparkSession, source_path: str, schema, sink_path: str, checkpoint: str,
                          window: str = "4 hours", watermark: str | None = None, value_col: str | None = None):
    """Run ST2 over files in ``source_path`` (``availableNow``); returns the StreamingQuery."""
    src = spark.readStream.schema(schema).parquet(source_path)
    agg = windowed_counts(src, window, watermark, value_col)

    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_path)

    return (agg.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def compact_changelog(spark: SparkSession, sink_path: str) -> DataFrame:
    """Latest emitted version of every (tenant, window)."""
    log = spark.read.parquet(sink_path)
    cols = [c for c in log.columns if c not in ("tenant_id", "window_start", "batch_id")]
    latest = log.groupBy("tenant_id", "window_start").agg(
        F.max_by(F.struct(*cols), "batch_id").alias("v"))
    return latest.select("tenant_id", "window_start", "v.*")
