"""Upserts (I15, I16) that rewrite only the buckets they touch.

A key's bucket is a hash of it. ``data/upsert_bucket=<b>/upsert_version=<tag>`` holds a bucket as one upsert left it; a version of the table is a small
manifest, ``versions/v00000001``, that names the folder of every bucket. An upsert merges its batch with the current folders of the
buckets that its keys fall in, writes those as new folders and publishes the next manifest by one rename; all other buckets
are named by it unchanged. A reader follows one manifest and so sees one version, whatever is written meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sessionscope.session import children, delete_path, rename_path, scratch_dir
from sessionscope.sources.sinks import latest_version, upsert

#: Buckets of a new table; an existing one keeps its own number.
BUCKETS = 64
#: Partition columns of the stored rows; no column of a table.
IN_BUCKET, AS_OF = "upsert_bucket", "upsert_version"
MANIFEST = "bucket int, folder string, buckets int"


def _manifest(spark: SparkSession, path: str) -> tuple[int, int | None, dict[int, str]]:
    """(number, buckets, folder by bucket) of the latest version: one row a bucket."""
    now = latest_version(spark, f"{path}/versions")
    if now is None:
        return 0, None, {}
    rows = spark.read.schema(MANIFEST).parquet(now).collect()
    return int(now.rsplit("v", 1)[1]), rows[0]["buckets"] if rows else None, {r["bucket"]: r["folder"] for r in rows}


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, folders: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """The latest version of a bucketed table."""
    return _read(spark, path, sorted(_manifest(spark, path)[2].values()), schema)


def merge_buckets(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], schema=None, order_col: str | None = None,
                  buckets: int = BUCKETS, keep_versions: int = 2) -> dict[int, str]:
    """Upsert ``batch`` (``sinks.upsert`` says how equal keys are settled) and return the folder of every bucket that was rewritten.

    ``schema`` is the table's; by default that of the batch. A batch without rows publishes nothing."""
    number, known, folders = _manifest(spark, path)
    buckets, tag = known or buckets, f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"
    scratch = scratch_dir(spark, f"merge-{uuid.uuid4().hex}", temporary=True)
    batch.withColumn(IN_BUCKET, _bucket(keys, buckets)).write.partitionBy(IN_BUCKET).parquet(scratch)
    staged = spark.read.schema(StructType([*batch.schema.fields, StructField(IN_BUCKET, IntegerType())])).parquet(scratch)
    touched = sorted(r[IN_BUCKET] for r in staged.select(IN_BUCKET).distinct().collect())    # at most the number of buckets
    schema = schema or batch.select(*[c for c in batch.columns if c != order_col]).schema
    if touched:
        existing = _read(spark, path, [folders[b] for b in touched if b in folders], schema)
        merged = upsert(existing, staged.drop(IN_BUCKET), keys, order_col).select(*existing.columns)
        tagged = merged.withColumns({IN_BUCKET: _bucket(keys, buckets), AS_OF: F.lit(tag)})
        tagged.hint("rebalance", IN_BUCKET).write.mode("append").partitionBy(IN_BUCKET, AS_OF).parquet(f"{path}/data")
        new = {b: f"data/{IN_BUCKET}={b}/{AS_OF}={tag}" for b in touched}
        private = f"{path}/.building-{uuid.uuid4().hex}"
        spark.createDataFrame([(b, f, buckets) for b, f in sorted((folders | new).items())], MANIFEST).coalesce(1).write.parquet(private)
        if not rename_path(spark, private, f"{path}/versions/v{number + 1:08d}"):
            delete_path(spark, private)
            raise RuntimeError(f"another run has written version {number + 1} of {path}")
        _forget(spark, path, touched, keep_versions)
    delete_path(spark, scratch)
    return new if touched else {}


def _forget(spark: SparkSession, path: str, touched: list[int], keep_versions: int) -> None:
    """Delete old manifests, and the folders of the touched buckets that no kept manifest names."""
    versions = sorted(n for n, _, _ in children(spark, f"{path}/versions") if n.startswith("v"))
    kept = {r["folder"] for v in versions[-keep_versions:] for r in spark.read.schema(MANIFEST).parquet(f"{path}/versions/{v}").collect()}
    for v in versions[:-keep_versions]:
        delete_path(spark, f"{path}/versions/{v}")
    for b in touched:
        for name, _, _ in children(spark, f"{path}/data/{IN_BUCKET}={b}"):
            if name.startswith(f"{AS_OF}=") and f"data/{IN_BUCKET}={b}/{name}" not in kept:
                delete_path(spark, f"{path}/data/{IN_BUCKET}={b}/{name}")
