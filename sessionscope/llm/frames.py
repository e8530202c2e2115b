"""Helpers shared by the operators: internal column names, sizes, tables written between steps."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.session import scratch_dir


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under internal names: extra or clashing columns of the caller drop out."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back (cuts lineage,
    survives lost executors, and is never computed twice)."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}-{uuid.uuid4().hex}", temporary=True)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows (one number to the driver)."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def words(text: Column) -> Column:
    """Words of a text: runs of anything but the bytes 0x20 and 0x09-0x0D; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
