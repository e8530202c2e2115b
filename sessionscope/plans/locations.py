"""Q3 per-location statistics and Q13 active locations list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.text import currency_label
from sessionscope.operators.filters import BRANCH, scope, tenant_filter
from sessionscope.operators.sessions import SESSION, without_purchase
from sessionscope.sources.fixtures import Tables

METRICS = ("total_revenue", "purchases", "total_visitors", "abandoned_carts", "repeat_visits",
           "failed_searches")


def location_stats(t: Tables, start: str | None, end: str | None,
                   tenant_id: str | None = None) -> DataFrame:
    """Q3: one row per active location. totalVisitors sums distinct sessions per
    (branch, user) -- a session seen with two users counts twice (reference rule)."""
    spark = t.purchase.sparkSession
    if start is None or end is None:
        return spark.range(0).select(F.lit(None).cast("string").alias("tenant_id"))
    sc = dict(tenant_id=tenant_id, start=start, end=end)
    key = ["tenant_id", "location_id"]
    pv = scope(t.page_view, **sc).withColumnRenamed(BRANCH, "location_id")
    # One (branch, user) pre-aggregate rolled up once into visitors and repeat visitors
    per_user = pv.groupBy("tenant_id", "location_id", "user_prop_webuserid").agg(
        F.count_distinct(SESSION).alias("session_count"))
    visitors = per_user.groupBy(*key).agg(
        F.sum("session_count").alias("total_visitors"),
        F.count(F.when(F.col("user_prop_webuserid").isNotNull() & (F.col("session_count") > 1), 1))
         .alias("repeat_visits"))
    purchases = scope(t.purchase, **sc).withColumnRenamed(BRANCH, "location_id").groupBy(*key).agg(
        F.sum("ecommerce_purchase_revenue").alias("total_revenue"), F.count(F.lit(1)).alias("purchases"))
    carts = (without_purchase(scope(t.add_to_cart, **sc).select("tenant_id", SESSION, BRANCH).distinct(),
                              t.with_purchase())
             .withColumnRenamed(BRANCH, "location_id")
             .groupBy(*key).agg(F.count(SESSION).alias("abandoned_carts")))
    failed = scope(t.no_search_results, **sc).withColumnRenamed(BRANCH, "location_id").groupBy(*key).agg(
        F.count(F.lit(1)).alias("failed_searches"))
    parts = [visitors, purchases, carts, failed]
    stats = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
             .filter(F.col("location_id").isNotNull())
             .groupBy(*key).agg(*[F.max(m).alias(m) for m in METRICS]))
    locs = active_locations(t, tenant_id)
    j = locs.join(stats, ["tenant_id", "location_id"], "left")
    z = lambda m: F.coalesce(F.col(m), F.lit(0)).cast("bigint")
    return j.select("tenant_id", "location_id", "location_name", "city", "state",
                    currency_label(F.col("total_revenue")).alias("total_revenue"),
                    *[z(m).alias(m) for m in METRICS[1:]])


def active_locations(t: Tables, tenant_id: str | None = None) -> DataFrame:
    """Active locations with their display columns."""
    return tenant_filter(t.locations, tenant_id).filter(F.col("is_active")).select(
        "tenant_id",
        F.col("warehouse_code").alias("location_id"),
        F.col("warehouse_name").alias("location_name"),
        "city", "state")


def locations_list(t: Tables, tenant_id: str | None = None) -> DataFrame:
    """Q13: active locations ordered by name."""
    return active_locations(t, tenant_id).orderBy("tenant_id", "location_name", "location_id")
