"""Sinks: idempotent date-range replace of event tables (I14), upserts of users and
locations (I15/I16) and the per-run record summary (I17).

Event tables are stored as Parquet partitioned by (tenant_id, event_date). A replace stages its new rows once and
then commits them by one dynamic partition overwrite: Spark's committer puts the (tenant, day) partitions that
have new rows in place of the stored ones, in one job, whatever their number. Days of the range that have no row any more are found from
the table's partition columns and only their folders are deleted. Last, the pairs that changed are added to the table's
change log, ``<table>.changes``, which readers that keep something derived (``streaming.rollups``) follow. Upserts write a new version
of the table to a new folder (plain Parquet has no MERGE), never the path being read; readers follow the latest complete version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionscope.session import children, delete_path, path_exists, rename_path
from sessionscope.sources.extract import EVENT_NAMES

SUMMARY_TYPES = list(EVENT_NAMES) + ["users_processed", "locations_processed"]
PAIR = ["tenant_id", "event_date"]
PAIR_SCHEMA = "tenant_id string, event_date date"


def changes_path(table_path: str) -> str:
    """Change log of an event table: the (tenant, day) pairs of every replace, one append a commit."""
    return f"{table_path.rstrip('/')}.changes"


def stored_pairs(spark: SparkSession, table_path: str) -> DataFrame:
    """Distinct (tenant, day) of a stored event table; only partition columns are read."""
    if not path_exists(spark, table_path):
        return spark.createDataFrame([], PAIR_SCHEMA)
    return spark.read.schema(PAIR_SCHEMA).parquet(table_path).select(*PAIR).distinct()


def _partition_folder(spark: SparkSession, table_path: str, tenant_id: str, day) -> str:
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{table_path}/tenant_id={escape(tenant_id)}/event_date={day}"


def replace_pairs(spark: SparkSession, table_path: str, staged: DataFrame, replaced: Callable[[DataFrame], DataFrame]) -> None:
    """Put the rows of ``staged`` (a stored frame, as it is read more than once) in place of their (tenant, day) pairs, and empty
    those stored pairs that ``replaced(stored pairs)`` names and ``staged`` has no row of; then log all of them.

    The overwrite is one job; the driver touches a folder only for a pair that is emptied. A run that is cut short is completed by
    running it again: it logs every pair that it stands for, changed before or not."""
    new = staged.select(*PAIR).distinct()
    emptied = replaced(stored_pairs(spark, table_path)).join(new, PAIR, "left_anti").collect()
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PAIR).parquet(table_path))
    for tenant_id, day in emptied:
        delete_path(spark, _partition_folder(spark, table_path, tenant_id, day))
    changed = new if not emptied else new.union(spark.createDataFrame([tuple(r) for r in emptied], PAIR_SCHEMA))
    changed.write.mode("append").parquet(changes_path(table_path))


def replace_date_range(spark: SparkSession, table_path: str, tenant_id: str | None, start: str, end: str,
                       rows: DataFrame, skip_if_empty: bool = True) -> str:
    """Delete the tenant's rows in [start, end] and insert those of ``rows`` that lie in it; idempotent.

    Rows outside the range are not part of the replace and are left out. ``tenant_id=None`` replaces the
    range for every tenant present in ``rows`` in one job. ``skip_if_empty`` keeps the service's behaviour:
    an empty batch leaves the old rows in place. Returns ``skipped`` / ``replaced``.
    """
    in_range = F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    new = (rows if tenant_id is None else rows.withColumn("tenant_id", F.lit(tenant_id))).filter(in_range)
    staging = f"{table_path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        new.hint("rebalance", *PAIR).write.partitionBy(*PAIR).parquet(staging)
        return replace_staged_range(spark, table_path, tenant_id, start, end, spark.read.schema(new.schema).parquet(staging), skip_if_empty)
    finally:
        delete_path(spark, staging)


def replace_staged_range(spark: SparkSession, table_path: str, tenant_id: str | None, start: str, end: str, staged: DataFrame,
                         skip_if_empty: bool = True) -> str:
    """``replace_date_range`` for rows that are stored already and lie in the range."""
    if skip_if_empty and staged.isEmpty():
        return "skipped"
    in_range = F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    own = F.col("tenant_id") == F.lit(tenant_id)

    def replaced(stored: DataFrame) -> DataFrame:
        stored = stored.filter(in_range)
        return stored.filter(own) if tenant_id is not None else stored.join(staged.select("tenant_id").distinct(), "tenant_id", "left_semi")

    replace_pairs(spark, table_path, staged, replaced)
    return "replaced"


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order_col: str | None = None,
           set_active: bool = True) -> DataFrame:
    """Insert-or-update by ``keys``. A batch holding a key twice keeps one row: the last by
    ``order_col`` (dropped from the result), and among equals, or without one, the greatest by all its columns, so
    the choice never depends on the order of the rows. Rows only in ``existing`` are kept unchanged (absent
    rows are not deactivated)."""
    rest = [F.col(c).desc_nulls_last() for c in new.columns if c not in keys and c != order_col]
    order = ([F.col(order_col).desc_nulls_last()] if order_col is not None else []) + rest or [F.col(keys[0])]
    w = Window.partitionBy(*keys).orderBy(*order)
    new = new.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn", *([order_col] if order_col else []))
    if set_active and "is_active" in existing.columns:
        new = new.withColumn("is_active", F.lit(True))
    kept = existing.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_users(existing: DataFrame, batch: DataFrame, tenant_id: str | None = None,
                 order_col: str | None = None) -> DataFrame:
    if tenant_id is not None:
        batch = batch.withColumn("tenant_id", F.lit(tenant_id))
    return upsert(existing, batch, ["tenant_id", "user_id"], order_col)


def upsert_locations(existing: DataFrame, batch: DataFrame, tenant_id: str | None = None,
                     order_col: str | None = None) -> DataFrame:
    if tenant_id is not None:
        batch = batch.withColumn("tenant_id", F.lit(tenant_id))
    return upsert(existing, batch, ["tenant_id", "warehouse_id"], order_col)


def latest_version(spark: SparkSession, table_path: str) -> str | None:
    """Folder of the newest complete version of a versioned table (``v00000001``, ...); None if there is none."""
    done = [n for n, _, _ in children(spark, table_path) if n.startswith("v") and path_exists(spark, f"{table_path}/{n}/_SUCCESS")]
    return f"{table_path}/{max(done)}" if done else None


def persist_upsert(spark: SparkSession, table_path: str, batch: DataFrame, keys: list[str], schema=None,
                   order_col: str | None = None, keep_versions: int = 2) -> str:
    """Upsert ``batch`` into a stored table: the merged rows become its next version (written under a private
    name, then renamed), and all but the last ``keep_versions`` are deleted. Returns the new folder."""
    now = latest_version(spark, table_path)
    columns = [c for c in batch.columns if c != order_col]
    existing = spark.read.parquet(now) if now else spark.createDataFrame([], schema or batch.select(*columns).schema)
    number = int(now.rsplit("v", 1)[1]) + 1 if now else 1
    target, private = f"{table_path}/v{number:08d}", f"{table_path}/.building-{uuid.uuid4().hex}"
    upsert(existing, batch, keys, order_col).write.parquet(private)
    if not rename_path(spark, private, target):
        delete_path(spark, private)
        raise RuntimeError(f"another run has written {target}")
    versions = [n for n, _, _ in children(spark, table_path) if n.startswith("v")]
    for old in sorted(versions)[:-keep_versions]:
        delete_path(spark, f"{table_path}/{old}")
    return target


def record_counts(counts: dict[str, DataFrame], by: str = "tenant_id") -> DataFrame:
    """(tenant, data_type, records) of every input: one grouped count each."""
    parts = [df.groupBy(by).agg(F.count(F.lit(1)).alias("records")).select(by, F.lit(t).alias("data_type"), "records") for t, df in counts.items()]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got


def ingest_run_summary(counts: dict[str, DataFrame] | DataFrame, failed_types=(), by: str = "tenant_id") -> DataFrame:
    """Record count per (tenant, type), zero-filled over the six event types plus
    users and locations; status ``completed_with_warnings`` when a type failed.

    ``counts`` are the inputs by type, each read once, or their ``record_counts``. The counts of a tenant are spread
    over the fixed list of types (missing ones at zero) after one grouped fold."""
    got = counts if isinstance(counts, DataFrame) else record_counts({t: df.select(by) for t, df in counts.items()}, by)
    per_tenant = got.groupBy(by).agg(*[F.sum(F.when(F.col("data_type") == t, F.col("records"))).alias(t) for t in SUMMARY_TYPES])
    status = "completed_with_warnings" if failed_types else "completed"
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("data_type"), F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias("records"))
                               for t in SUMMARY_TYPES])).alias("r")
    return per_tenant.select(by, rows).select(by, "r.data_type", "r.records", F.lit(status).alias("status"))
