"""Q2 chart data: revenue, purchases, visitors, abandoned carts and searches per
time bucket, zero-filled on a spine of buckets (six granularities).

The four bucketed aggregates are folded by one groupBy on (tenant, bucket label). A tenant's measured buckets are then
collected, at most one a bucket, and take the tenant's spine along (``explode(sequence())``, not a join); a second groupBy
brings both together. Buckets that are not on the spine vanish, exactly like the reference's LEFT JOIN from the spine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.text import money
from sessionscope.functions.timebucket import (SUB_DAY, bucket_label, bucket_start, event_bucket_ts,
                                               is_digits, normalize_granularity, spine_points)
from sessionscope.operators.filters import scope
from sessionscope.operators.sessions import SESSION, without_purchase
from sessionscope.sources.fixtures import Tables

METRICS = ("revenue", "purchases", "visitors", "carts", "searches")


def _bucketed(df: DataFrame, g: str) -> DataFrame:
    if g in SUB_DAY:
        df = df.filter(is_digits(F.col("event_timestamp")))
    ts = event_bucket_ts(F.col("event_date"), F.col("event_timestamp"), g)
    return df.withColumn("date_group", bucket_label(bucket_start(ts, g), g))


def chart_parts(t: Tables, start: str, end: str, g: str, tenant_id=None, location_id=None):
    sc = dict(tenant_id=tenant_id, location_id=location_id, start=start, end=end)
    key = ["tenant_id", "date_group"]
    purchases = _bucketed(scope(t.purchase, **sc), g).groupBy(*key).agg(
        F.sum("ecommerce_purchase_revenue").alias("revenue"), F.count(F.lit(1)).alias("purchases"))
    visitors = _bucketed(scope(t.page_view, **sc), g).groupBy(*key).agg(
        F.count_distinct(SESSION).alias("visitors"))
    abandoned = without_purchase(
        scope(t.add_to_cart, **sc).select("tenant_id", SESSION, "event_date", "event_timestamp").distinct(),
        t.with_purchase())
    carts = _bucketed(abandoned, g).groupBy(*key).agg(F.count_distinct(SESSION).alias("carts"))
    cols = ["tenant_id", "event_date", "event_timestamp"]
    searches = _bucketed(scope(t.view_search_results, **sc).select(*cols)
                         .unionByName(scope(t.no_search_results, **sc).select(*cols)), g) \
        .groupBy(*key).agg(F.count(F.lit(1)).alias("searches"))
    return [purchases, visitors, carts, searches]


def rolled_parts(rollups: dict[str, DataFrame], start: str, end: str, g: str, tenant_id=None, location_id=None) -> list[DataFrame]:
    """``chart_parts`` from the contributions of ``streaming.rollups``: rows a (day, hour, session) with their events and revenue."""
    sc = dict(tenant_id=tenant_id, location_id=location_id, start=start, end=end)
    key = ["tenant_id", "date_group"]

    def bucketed(df: DataFrame) -> DataFrame:
        ts = F.col("hour_start") if g in SUB_DAY else F.col("event_date").cast("timestamp")
        df = df.filter(F.col("hour_start").isNotNull()) if g in SUB_DAY else df
        return df.withColumn("date_group", bucket_label(bucket_start(ts, g), g))

    scoped = {name: scope(df, **sc) for name, df in rollups.items()}
    purchases = bucketed(scoped["purchase"]).groupBy(*key).agg(F.sum("revenue").alias("revenue"), F.sum("events").alias("purchases"))
    visitors = bucketed(scoped["page_view"]).groupBy(*key).agg(F.count_distinct(SESSION).alias("visitors"))
    carts = bucketed(without_purchase(scoped["add_to_cart"].select("tenant_id", SESSION, "event_date", "hour_start").distinct(), rollups["purchase"])) \
        .groupBy(*key).agg(F.count_distinct(SESSION).alias("carts"))
    searches = bucketed(scoped["view_search_results"].unionByName(scoped["no_search_results"])).groupBy(*key).agg(F.sum("events").alias("searches"))
    return [purchases, visitors, carts, searches]


def chart_data(t: Tables, start: str | None, end: str | None, granularity: str | None,
               tenant_id: str | None = None, location_id: str | None = None) -> DataFrame:
    """Q2: one row per (tenant, bucket) of the spine."""
    return chart_from_parts(t.purchase.sparkSession, lambda g: chart_parts(t, start, end, g, tenant_id, location_id), start, end, granularity, tenant_id)


def chart_from_parts(spark: SparkSession, parts_of: Callable[[str], list[DataFrame]], start: str | None, end: str | None,
                     granularity: str | None, tenant_id: str | None = None) -> DataFrame:
    """The bucketed aggregates of a granularity on the spine of the period.

    The four bucketed aggregates and the spine rows (no metrics, but their period start) are brought together per tenant and
    folded by one groupBy on (tenant, label): buckets off the spine have no period start and vanish, as do rows
    whose timestamp is not a time (their label is NULL); buckets without rows keep their zeros."""
    g = normalize_granularity(granularity)
    if start is None or end is None:
        return spark.range(0).select(F.lit(None).cast("string").alias("tenant_id"))
    measured = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts_of(g))
    measured = measured.groupBy("tenant_id", "date_group").agg(*[F.max(m).alias(m) for m in METRICS])
    kinds = {f.name: f.dataType for f in measured.schema.fields}
    buckets = F.array_distinct(F.transform(spine_points(start, end, g), lambda p: F.struct(
        bucket_label(bucket_start(p, g), g).alias("date_group"), bucket_start(p, g).alias("period_start"))))
    spine = F.transform(buckets, lambda b: F.struct(b["date_group"].alias("date_group"), b["period_start"].alias("period_start"),
                                                    *[F.lit(None).cast(kinds[m]).alias(m) for m in METRICS]))
    own = F.struct("date_group", F.lit(None).cast("timestamp").alias("period_start"), *METRICS)
    # a tenant's measured buckets meet once, at most one a bucket, to take the spine along: no second pass finds the tenants
    per_tenant = measured.filter(F.col("date_group").isNotNull()).groupBy("tenant_id").agg(F.collect_list(own).alias("own"))
    if tenant_id is not None:    # a tenant without any rows still gets its zero-filled spine
        per_tenant = spark.range(1).select(F.lit(tenant_id).alias("tenant_id")).join(per_tenant, "tenant_id", "left")
    rows = F.explode(F.concat(F.coalesce("own", F.array().cast(per_tenant.schema["own"].dataType)), spine)).alias("b")
    both = per_tenant.select("tenant_id", rows).select("tenant_id", "b.*")
    folded = both.groupBy("tenant_id", "date_group").agg(
        F.max("period_start").alias("period_start"), *[F.max(m).alias(m) for m in METRICS])
    z = lambda m: F.coalesce(F.col(m), F.lit(0)).cast("bigint")
    return folded.filter(F.col("period_start").isNotNull()).select(
        "tenant_id", "date_group", F.date_format("period_start", "yyyy-MM-dd HH:mm:ss").alias("period_start"),
        money(F.coalesce(F.col("revenue"), F.lit(0))).alias("revenue"), *[z(m).alias(m) for m in METRICS[1:]])

