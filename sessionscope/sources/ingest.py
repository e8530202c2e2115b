"""Ingest run: extract a date range of the raw export (I1-I8), correct mistagged searches (I13), replace the range in
every chosen event table (I14), upsert users and locations (I15, I16) and sum the run up (I17).

One scan of the export flattens all six types and writes them to a staging table partitioned by (event_table, tenant, day).
Each type is then put in place by itself, from its part of the staging table.

Failures are isolated by type. If the one scan fails, for a row or an unreadable file, every type is staged by a scan of
its own instead, over its own event names, and only those whose scan fails are left out; a type that cannot be put in place (a storage
error) is left out likewise. Types left out keep their old rows, the others proceed, and the run ends
``completed_with_warnings``.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.session import children, delete_path, scratch_dir, side_by_side
from sessionscope.sources.buckets import merge_buckets
from sessionscope.sources.extract import EVENT_NAMES, EXTRA_COLUMNS, extract_events, reclassified, scan_range
from sessionscope.sources.fixtures import COMMON_EVENT_COLUMNS
from sessionscope.sources.sinks import ingest_run_summary, record_counts, replace_staged_range

#: What one run can load; the default is all of it.
DATA_TYPES = ("events", "users", "locations")
DEFAULT_DAYS_BACK = 2


@dataclass
class IngestRun:
    summary: DataFrame
    failed: dict[str, str] = field(default_factory=dict)


def default_window(today: dt.date) -> tuple[str, str]:
    """The last days up to today, re-ingested to pick up late events."""
    return (today - dt.timedelta(days=DEFAULT_DAYS_BACK)).isoformat(), today.isoformat()


#: What Spark raises for a failed job or plan, with or without its own exception class, and what a data source in Python raises.
FAILURES = (PySparkException, Py4JJavaError, RuntimeError, OSError)


def first_line(error: Exception) -> str:
    """The first line that says something; the class of an error without a message."""
    text = str(error.java_exception) if isinstance(error, Py4JJavaError) else str(error)
    return next((x.strip() for x in text.splitlines() if x.strip()), type(error).__name__)[:500]


def _write_staged(events: DataFrame, staging: str, mode: str = "append") -> None:
    events.hint("rebalance", "event_table", "tenant_id", "event_date").write.mode(mode).partitionBy("event_table", "tenant_id", "event_date").parquet(staging)


def stage_events(raw: DataFrame, start: str | None, end: str | None, staging: str, extracted: dict[str, DataFrame] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """(the staging table: ``event_table`` and the columns of all types, mistagged searches corrected; the types that failed).

    ``extracted`` replaces the raw rows of single types. All others come from one scan; only if that fails, each from its own."""
    extracted = extracted or {}
    wide = extract_events(raw, start, end).drop("raw_data")
    columns = wide.columns
    failed: dict[str, str] = {}

    def attempt(name: str, events: DataFrame) -> None:
        part = f"{staging}/of={name}"
        try:
            _write_staged(reclassified(events), part)
        except FAILURES as error:
            failed[name] = first_line(error)
            delete_path(raw.sparkSession, part)

    attempt("all", wide.filter(~F.col("event_table").isin(list(extracted))) if extracted else wide)
    if failed.pop("all", None):
        for name in EVENT_NAMES:
            if name not in extracted:
                own = extract_events(scan_range(raw, None, None, EVENT_NAMES[name]), start, end).drop("raw_data")
                attempt(name, own.filter(F.col("event_table") == name))
    for name, rows in extracted.items():
        given = {c: F.col(c) for c in COMMON_EVENT_COLUMNS + EXTRA_COLUMNS[name]}
        attempt(name, rows.select(F.lit(name).alias("event_table"), *[given.get(c, F.lit(None)).cast(wide.schema[c].dataType).alias(c) for c in columns[1:]]))
    spark = raw.sparkSession
    return (spark.read.schema(wide.schema).parquet(staging).select(*columns) if children(spark, staging) else spark.createDataFrame([], wide.schema)), failed


def staged_table(staged: DataFrame, table: str) -> DataFrame:
    """One type's rows of the staging table, with its table's columns."""
    return staged.filter(F.col("event_table") == table).select(*COMMON_EVENT_COLUMNS, *EXTRA_COLUMNS[table])


def run_ingest(spark: SparkSession, warehouse: str, start: str, end: str, raw: DataFrame | None = None,
               users: DataFrame | None = None, locations: DataFrame | None = None, data_types=DATA_TYPES,
               extracted: dict[str, DataFrame] | None = None) -> IngestRun:
    """One run for all tenants of its inputs. ``users`` and ``locations`` are the cleaned masters (I9, I10) with a
    tenant_id; ``extracted`` replaces single event types' raw rows. Tables are written below ``warehouse``:
    event tables partitioned by (tenant, day), masters as bucketed tables (``buckets.read_buckets``). The summary counts what this run
    staged, whatever its tables held before."""
    unknown = set(data_types) - set(DATA_TYPES)
    if unknown or start > end:
        raise ValueError(f"unknown data types {sorted(unknown)}" if unknown else "the range ends before it starts")
    failed: dict[str, str] = {}
    scratch = scratch_dir(spark, f"ingest-run-{uuid.uuid4().hex}", temporary=True)
    counts = [spark.createDataFrame([], "tenant_id string, data_type string, records bigint")]

    if "events" in data_types and raw is not None:
        staged, failed = stage_events(raw, start, end, f"{scratch}/staging", extracted)
        staged = staged.filter(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        errors = side_by_side(spark, {name: partial(replace_staged_range, spark, f"{warehouse}/{name}", None, start, end, staged_table(staged, name))
                                      for name in EVENT_NAMES if name not in failed})
        for name, error in errors.items():
            if not isinstance(error, FAILURES):
                raise error
            failed[name] = first_line(error)
        done = F.col("event_table").isin([n for n in EVENT_NAMES if n not in failed])
        staged.groupBy("tenant_id", F.col("event_table").alias("data_type")).agg(F.sum(F.when(done, 1).otherwise(0)).alias("records")).write.parquet(f"{scratch}/counts")
        counts.append(spark.read.parquet(f"{scratch}/counts"))
        delete_path(spark, f"{scratch}/staging")
    for kind, batch, keys in (("users", users, ["tenant_id", "user_id"]), ("locations", locations, ["tenant_id", "warehouse_id"])):
        if kind in data_types and batch is not None:
            try:
                merge_buckets(spark, f"{warehouse}/{kind}", batch.withColumn("is_active", F.lit(True)), keys)
                counts.append(record_counts({f"{kind}_processed": batch}))
            except FAILURES as error:
                failed[f"{kind}_processed"] = first_line(error)
    found = counts[0]
    for part in counts[1:]:
        found = found.unionByName(part)
    return IngestRun(ingest_run_summary(found, sorted(failed)), failed)
