"""ST1: incremental re-ingest with Structured Streaming.

An export is a folder ``export_id=<id>`` of raw files under the landing path; ids grow. Each
export is complete for every (tenant, day) that it holds, and may land in any number of files. New
files are picked up by a file stream (``trigger(availableNow=True)`` -- run it on a schedule, it
stops when caught up).

The stream keeps an index beside its checkpoint: which file of which export holds which (tenant, day). A micro-batch reads
only those three columns of its new files and adds them. For the pairs that it touches, the index names the latest
export and its files, and only those files are read: never the micro-batch alone, which may be one part of an export or mix several,
and never the rest of the landing. Their rows replace the pairs in every event table. Days that the batch does not touch keep
their rows. A batch's part of the index is written under its id, so a batch that is replayed after a failure, or split over
several triggers, ends in the same tables; progress is tracked in the stream checkpoint under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from functools import partial
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sessionscope.session import delete_path, scratch_dir, side_by_side
from sessionscope.sources.extract import EVENT_NAMES, parse_event_date
from sessionscope.sources.fixtures import COMMON_EVENT_COLUMNS
from sessionscope.sources.ingest import stage_events, staged_table
from sessionscope.sources.sinks import PAIR, replace_pairs

EXPORT = "export_id"
INDEX_SCHEMA = f"tenant_id string, event_date string, {EXPORT} bigint, file string, batch bigint"


def landing_schema(raw_schema: StructType) -> StructType:
    return StructType([*(f for f in raw_schema.fields if f.name != EXPORT), StructField(EXPORT, LongType())])


def index_path(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/export-index"


def current_exports(index: DataFrame, batch_id: int) -> DataFrame:
    """(tenant, day, export, file) of the pairs that a batch touched, for the latest export that holds them."""
    touched = index.filter(F.col("batch") == batch_id).select(*PAIR).distinct()
    own = index.join(touched, PAIR, "left_semi")
    newest = own.groupBy(*PAIR).agg(F.max(EXPORT).alias(EXPORT))
    return own.join(newest, [*PAIR, EXPORT], "left_semi").select(*PAIR, EXPORT, "file").distinct()


def _replace_batch(spark: SparkSession, landing: str, schema: StructType, warehouse: str, index: str, batch: DataFrame, batch_id: int) -> None:
    seen = batch.filter("tenant_id is not null and event_date rlike '^[0-9]{8}$'").distinct()
    seen.write.mode("overwrite").parquet(f"{index}/batch={batch_id}")
    current = scratch_dir(spark, f"reingest-{uuid.uuid4().hex}", temporary=True)
    current_exports(spark.read.schema(INDEX_SCHEMA).parquet(index), batch_id).write.parquet(f"{current}/exports")
    exports = spark.read.parquet(f"{current}/exports")
    files = [unquote(r["file"]) for r in exports.select("file").distinct().collect()]    # the file list of the scan below
    if files:
        rows = spark.read.schema(schema).option("basePath", landing).parquet(*files).join(exports.select(*PAIR, EXPORT).distinct(), [*PAIR, EXPORT], "left_semi").drop(EXPORT)
        staged, failed = stage_events(rows.select(*[f.name for f in schema.fields if f.name != EXPORT]), None, None, f"{current}/staging")
        if failed:    # the batch is not done: the stream stops here and tries it again
            raise RuntimeError(f"not staged: {failed}")
        pairs = exports.select("tenant_id", parse_event_date(F.col("event_date")).alias("event_date")).distinct()
        first, last = pairs.agg(F.min("event_date"), F.max("event_date")).first()

        def replaced(stored: DataFrame) -> DataFrame:
            return stored.filter(F.col("event_date").between(F.lit(first), F.lit(last))).join(pairs, PAIR, "left_semi")

        errors = side_by_side(spark, {name: partial(replace_pairs, spark, f"{warehouse}/{name}", staged_table(staged, name), replaced) for name in EVENT_NAMES})
        for error in errors.values():    # likewise not done
            raise error
    delete_path(spark, current)


def incremental_reingest(spark: SparkSession, raw_path: str, warehouse: str, checkpoint: str,
                         raw_schema=None, max_files_per_trigger: int | None = None):
    """Start the stream over ``raw_path`` (folders ``export_id=<id>``); returns the StreamingQuery
    (``availableNow``: ends when caught up)."""
    schema = landing_schema(raw_schema or spark.read.parquet(raw_path).schema)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(raw_path).select(*PAIR, EXPORT, F.col("_metadata.file_path").alias("file"))
    return (stream.writeStream
            .foreachBatch(lambda df, batch_id: _replace_batch(spark, raw_path, schema, warehouse, index_path(checkpoint), df, batch_id))
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start())


__all__ = ["EXPORT", "incremental_reingest", "COMMON_EVENT_COLUMNS"]
