"""Q1 overview KPIs (one row per tenant).

Five independent aggregates (purchases, visitors with unique and repeat users,
abandoned carts, searches, failed searches). Instead of crossing one-row frames, each aggregate is keyed by
tenant, the partial rows are unioned and folded by one small groupBy -- no joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.text import currency_label
from sessionscope.operators.filters import scope, tenant_filter
from sessionscope.operators.sessions import SESSION, without_purchase
from sessionscope.sources.fixtures import Tables

METRICS = ("total_revenue", "purchases", "total_visitors", "unique_users", "abandoned_carts",
           "total_searches", "failed_searches", "repeat_visits")


def overview_parts(t: Tables, start: str, end: str, tenant_id: str | None = None,
                   location_id: str | None = None) -> list[DataFrame]:
    sc = dict(tenant_id=tenant_id, location_id=location_id, start=start, end=end)
    purchase = scope(t.purchase, **sc).groupBy("tenant_id").agg(
        F.sum("ecommerce_purchase_revenue").alias("total_revenue"),
        F.count(F.lit(1)).alias("purchases"))
    # visitors, unique users and repeat visitors in one pass over page_view: every row
    # is listed once under its session and once under its user (with the session),
    # so one distinct-count chain gives sessions per tenant and sessions per user
    pv = scope(t.page_view, **sc)
    tagged = pv.select("tenant_id", F.explode(F.array(
        F.struct(F.lit("s").alias("kind"), F.col(SESSION).alias("key"), F.lit(None).cast("string").alias("sess")),
        F.struct(F.lit("u").alias("kind"), F.col("user_prop_webuserid").alias("key"), F.col(SESSION).alias("sess")),
    )).alias("_k")).select("tenant_id", "_k.*").filter(F.col("key").isNotNull())
    per_key = tagged.groupBy("tenant_id", "kind", "key").agg(F.count_distinct("sess").alias("n"))
    is_user = F.col("kind") == "u"
    visitors = per_key.groupBy("tenant_id").agg(
        F.count(F.when(~is_user, 1)).alias("total_visitors"),
        F.count(F.when(is_user, 1)).alias("unique_users"),
        F.count(F.when(is_user & (F.col("n") > 1), 1)).alias("repeat_visits"))
    carts = without_purchase(
        scope(t.add_to_cart, **sc).select("tenant_id", SESSION).distinct(),
        tenant_filter(t.with_purchase(), tenant_id),
        salt=["tenant_id"],
    ).groupBy("tenant_id").agg(F.count_distinct(SESSION).alias("abandoned_carts"))
    searches = scope(t.view_search_results, **sc).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total_searches"))
    failed = scope(t.no_search_results, **sc).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("failed_searches"))
    return [purchase, visitors, carts, searches, failed]


def overview_stats(t: Tables, start: str | None, end: str | None, tenant_id: str | None = None,
                   location_id: str | None = None) -> DataFrame:
    """Q1. Missing start or end date gives the zero row (API behaviour)."""
    spark = t.purchase.sparkSession
    if start is None or end is None:
        parts = []
    else:
        parts = overview_parts(t, start, end, tenant_id, location_id)
    if tenant_id is not None:
        # A tenant without any rows still gets its (zero) row.
        parts.append(spark.range(1).select(F.lit(tenant_id).alias("tenant_id"), F.lit(None).cast("decimal(25,2)").alias(METRICS[0]),
                                           *[F.lit(None).cast("bigint").alias(m) for m in METRICS[1:]]))
    if not parts:
        return spark.range(0).select(F.lit(None).cast("string").alias("tenant_id"),
                                     *[F.lit(0).cast("bigint").alias(m) for m in METRICS[1:]])
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    g = u.groupBy("tenant_id").agg(*[F.max(m).alias(m) for m in METRICS])
    z = lambda m: F.coalesce(F.col(m), F.lit(0)).cast("bigint")
    return g.select(
        "tenant_id",
        currency_label(F.col("total_revenue")).alias("total_revenue"),
        *[z(m).alias(m) for m in METRICS[1:]],
        F.when(z("total_visitors") > 0,
               F.round(z("purchases").cast("decimal(38,10)") / z("total_visitors") * 100, 2))
         .otherwise(F.lit(0)).cast("double").alias("conversion_rate"),
    )
