"""Sorting and paging: L1 dynamic sort, L2/L3 LIMIT/OFFSET pages, W1 total count,
Q18 page envelope.

Pages are taken per tenant in two phases: the best ``offset + limit`` rows of every salt
of a tenant first, then of the tenant. Up to Spark's own threshold
(``spark.sql.optimizer.windowGroupLimitThreshold``) its partial WindowGroupLimit does the first
phase inside the map tasks; beyond it the salted window does, on as many tasks as there are
salts, so no task ever sorts a whole tenant. ``COUNT(*) OVER ()`` (which Spark would run in a
single partition) becomes a grouped count joined back.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.session import scratch_dir


#: Parts of a tenant that are cut to the page's depth by themselves, for pages deeper than Spark's threshold.
PAGE_SALTS = 64


def sort_spec(sort_field: str | None, sort_order: str | None, allowed: Sequence[str],
              fallback: str, tie_breakers: Sequence[str]) -> list[Column]:
    """L1: chosen field NULLS LAST in the chosen direction; then the fallback
    field DESC (PostgreSQL default: NULLS FIRST); then unique tie-breakers."""
    spec: list[Column] = []
    if sort_field in allowed and sort_order in ("asc", "desc"):
        c = F.col(sort_field)
        spec.append(c.desc_nulls_last() if sort_order == "desc" else c.asc_nulls_last())
    spec.append(F.col(fallback).desc_nulls_first())
    spec.extend(F.col(t).asc_nulls_first() for t in tie_breakers)
    return spec


def with_total_count(df: DataFrame, by: Sequence[str] = ("tenant_id",),
                     name: str = "total_count", rows: DataFrame | None = None) -> DataFrame:
    """``COUNT(*) OVER (PARTITION BY tenant)`` as grouped count + join.

    ``rows`` (default ``df``) receives the totals of ``df`` -- pass a page of ``df``
    to count everything but join the totals to the page rows only.

    Totals per tenant alone are one row per tenant: their size is bounded by the
    number of tenants, not by the data, so they are broadcast. A shuffle join on
    ``tenant_id`` would send every row of a tenant to one reducer. Totals over
    composite keys (tenant, branch, day) are left to Spark's size-based choice;
    those keys spread over reducers."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    if tuple(by) == ("tenant_id",):
        counts = F.broadcast(counts)
    return (df if rows is None else rows).join(counts, list(by), "left")


def paged_with_total(df: DataFrame, order: Sequence[Column], page: int | None, limit: int | None,
                     by: Sequence[str] = ("tenant_id",), offset: int | None = None,
                     single_group: bool = False) -> DataFrame:
    """L2/L3 + W1: cut the page first (partial top-k before the shuffle), then join the
    per-partition totals to the page rows only."""
    page_rows = take_page(df, order, page, limit, by, offset, single_group=single_group)
    return with_total_count(df, by, rows=page_rows)


def take_page(df: DataFrame, order: Sequence[Column], page: int | None, limit: int | None,
              by: Sequence[str] = ("tenant_id",), offset: int | None = None,
              position: str = "row_num", single_group: bool = False) -> DataFrame:
    """L2 (``page``/``limit``) or L3 (``offset``/``limit``): the requested slice per tenant,
    with its 1-based position in the full ordering.

    ``single_group`` (the caller filtered to one tenant): a plain ORDER BY / OFFSET /
    LIMIT, planned as TakeOrderedAndProject -- a bounded heap per task, no full sort."""
    w = Window.partitionBy(*by).orderBy(*order)
    if limit is not None and single_group:
        first = offset if offset is not None else (max(page or 1, 1) - 1) * limit
        top = df.orderBy(*order).offset(first).limit(limit)
        return top.withColumn(position, (F.lit(first) + F.row_number().over(w)).cast("bigint"))
    first = 0 if limit is None else offset if offset is not None else (max(page or 1, 1) - 1) * limit
    if limit is not None and first + limit > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(PAGE_SALTS))
        own = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", salt).withColumn("_own", F.row_number().over(own))
              .filter(F.col("_own") <= first + limit).drop("_salt", "_own"))
    ranked = df.withColumn(position, F.row_number().over(w))
    if limit is not None:
        # the filter sits directly on row_number(): Spark plans a partial WindowGroupLimit
        ranked = ranked.filter((F.col(position) > first) & (F.col(position) <= first + limit))
    return ranked.withColumn(position, F.col(position).cast("bigint"))


def select_pages(df: DataFrame, order: Sequence[Column], pages: Sequence[tuple[int, int]], by: Sequence[str] = ("tenant_id",),
                 position: str = "row_num", ranges: int | None = None) -> DataFrame:
    """L2/L3 at any depth: the rows of the (offset, limit) ``pages`` of every group, with their position in its ordering.

    Distributed selection: the rows are dealt out in ranges of (group, order) by sampled bounds and written by range. The number
    of rows of a group in each range says which ranges hold the pages; only those are read again and sorted, range by
    range, and the counts before a range give its first position. No task holds more than a range, however deep the page.
    ``order`` should end with a unique tie-breaker, as everywhere; rows equal in it share a range."""
    spark = df.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = scratch_dir(spark, f"pages-{uuid.uuid4().hex}", temporary=True)
    dealt = df.repartitionByRange(ranges, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    dealt.write.partitionBy("_range").parquet(root)
    rows = spark.read.schema(dealt.schema).parquet(root)
    counts = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))    # one number a group and range
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    held = reduce(lambda a, b: a | b, [(F.col("_before") < first + limit) & (F.col("_before") + F.col("_n") > first) for first, limit in pages])
    path = scratch_dir(spark, f"held-{uuid.uuid4().hex}", temporary=True)
    counts.filter(held).drop("_n").write.parquet(path)
    held = spark.read.parquet(path)
    needed = [r["_range"] for r in held.select("_range").distinct().collect()]    # at most the number of ranges
    same = reduce(lambda a, b: a & b, [F.col(f"rows.{c}").eqNullSafe(F.col(f"held.{c}")) for c in [*by, "_range"]])
    own = rows.filter(F.col("_range").isin(needed)).alias("rows").join(held.alias("held"), same).select("rows.*", "held._before")
    at = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) + F.col("_before")
    on_page = reduce(lambda a, b: a | b, [(F.col(position) > first) & (F.col(position) <= first + limit) for first, limit in pages])
    return own.withColumn(position, at.cast("bigint")).filter(on_page).drop("_before", "_range")


def page_envelope(totals: DataFrame, page: int, limit: int, total_col: str = "total_count",
                  by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """Q18: total, page, limit, has_more; past-the-end pages give NULL total and has_more."""
    first = (max(page, 1) - 1) * limit
    t = F.col(total_col)
    on_page = t > first
    return totals.select(
        *by,
        F.when(on_page, t).alias("total"),
        F.lit(page).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("limit"),
        F.when(on_page, F.lit(page * limit) < t).alias("has_more"),
    )
