"""Small queries exercising single building blocks of the inventory (P*, J*, A*,
W*, L*, U*, S*) over whole fixture tables. The analytic queries compose the
same helpers; these keep each operator individually checkable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.functions import text, timebucket
from sessionscope.functions.kv import first_item, kv_int_first, kv_string_first, to_json_keep_nulls
from sessionscope.operators.filters import digits_only
from sessionscope.operators.identity import resolve_users
from sessionscope.operators.paging import take_page, with_total_count
from sessionscope.operators.sessions import SESSION, distinct_sessions, in_sessions, without_purchase
from sessionscope.plans.worklists import session_products, items_text, PRODUCT_FIELDS
from sessionscope.sources.fixtures import Tables

USER = "user_prop_webuserid"


# ---------------------------------------------------------------- joins
def identity_pairs(t: Tables) -> DataFrame:
    """(purchase event, resolved user) pairs with ERP fan-out."""
    p = t.purchase.select("tenant_id", "event_id", USER, "user_prop_webcustomerid")
    return resolve_users(p, t.users, salt=["event_id"]).select("tenant_id", "event_id", "user_id")


def carts_without_purchase(t: Tables) -> DataFrame:
    """Cart rows whose session never purchased."""
    return without_purchase(t.add_to_cart.select("tenant_id", "event_id", SESSION), t.with_purchase(),
                            salt=["event_id"]).select("tenant_id", "event_id")


def page_views_in_cart_sessions(t: Tables) -> DataFrame:
    """Page views of sessions that have a cart event."""
    return in_sessions(t.page_view, t.add_to_cart).select("tenant_id", "event_id")


# ---------------------------------------------------------------- aggregations
def revenue_per_day(t: Tables) -> DataFrame:
    """A1 + S7: summed revenue per (tenant, day), NULL -> 0, and its '$' label."""
    g = t.purchase.groupBy("tenant_id", "event_date").agg(F.sum("ecommerce_purchase_revenue").alias("rev"))
    return g.select("tenant_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
                    text.money(F.coalesce(F.col("rev"), F.lit(0))).alias("revenue"),
                    text.currency_label(F.col("rev")).alias("revenue_label"))


def rows_per_table(t: Tables) -> DataFrame:
    """A2: COUNT(*) per (tenant, table)."""
    parts = [df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("table_name", F.lit(n))
             for n, df in t.events().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct_counts(t: Tables) -> DataFrame:
    """A3: exact distinct sessions, users and pages per tenant (NULL ignored)."""
    return t.page_view.groupBy("tenant_id").agg(
        F.count_distinct(SESSION).alias("sessions"), F.count_distinct(USER).alias("users"),
        F.count_distinct("param_page_location").alias("pages"))


def session_last_activity(t: Tables) -> DataFrame:
    """A4: MAX(event_timestamp) (text order) and MAX(customer id) per (session, user)."""
    return t.page_view.groupBy("tenant_id", SESSION, USER).agg(
        F.max("event_timestamp").alias("last_activity"), F.max("user_prop_webcustomerid").alias("max_customer"))


def multi_session_users(t: Tables) -> DataFrame:
    """Users with more than one distinct session (HAVING)."""
    return (t.page_view.filter(F.col(USER).isNotNull()).groupBy("tenant_id", USER)
            .agg(F.count_distinct(SESSION).alias("sessions")).filter(F.col("sessions") > 1))


def cart_value_per_session(t: Tables) -> DataFrame:
    """SUM(price * quantity) per session (row NULL when either is NULL)."""
    return t.add_to_cart.groupBy("tenant_id", SESSION).agg(
        text.money(F.sum(F.col("first_item_price") * F.col("first_item_quantity"))).alias("cart_value"))


def cart_items_per_session(t: Tables) -> DataFrame:
    """The multiset of cart item structs per session, pre-aggregated per item."""
    from sessionscope.plans.worklists import CART_ITEM_FIELDS, _multiset
    m = _multiset([F.col("first_item_item_id").alias("item_id"), F.col("first_item_item_name").alias("item_name"),
                   F.col("first_item_item_category").alias("item_category"),
                   F.col("first_item_price").alias("price"), F.col("first_item_quantity").alias("quantity")],
                  ["tenant_id", SESSION], t.add_to_cart, "products")
    return m.select("tenant_id", SESSION, items_text(F.col("products"), CART_ITEM_FIELDS).alias("products"))


def viewed_products_per_session(t: Tables) -> DataFrame:
    """Distinct viewed products per session (items present only)."""
    sp = session_products(t, t.view_item.select("tenant_id", SESSION))
    return sp.select("tenant_id", SESSION, "products_viewed",
                     items_text(F.col("products_details"), PRODUCT_FIELDS).alias("products_details"))


def search_terms_per_session(t: Tables) -> DataFrame:
    """A10: distinct terms joined by ', ' per session; NULL when none."""
    terms = F.array_join(F.array_sort(F.collect_set("param_search_term")), ", ")
    return t.view_search_results.groupBy("tenant_id", SESSION).agg(terms.alias("terms")) \
        .withColumn("terms", F.when(F.col("terms") != "", F.col("terms")))


def entry_pages(t: Tables) -> DataFrame:
    """First page of each (session, user) by time (ties by event id)."""
    return t.page_view.groupBy("tenant_id", SESSION, USER).agg(
        F.min_by("param_page_location", F.struct("event_timestamp", "event_id")).alias("entry_page"))


def branch_visitor_levels(t: Tables) -> DataFrame:
    """Per (branch, user) distinct sessions, then per branch sum and repeat users."""
    per_user = t.page_view.groupBy("tenant_id", "user_prop_default_branch_id", USER).agg(
        F.count_distinct(SESSION).alias("n"))
    return per_user.groupBy("tenant_id", F.col("user_prop_default_branch_id").alias("branch")).agg(
        F.sum("n").cast("bigint").alias("visitors"),
        F.count(F.when((F.col("n") > 1) & F.col(USER).isNotNull(), 1)).alias("repeat_users"))


def conversion_per_day(t: Tables) -> DataFrame:
    """Purchases / distinct visitor sessions * 100 rounded to 2, 0 when no visitors."""
    p = t.purchase.groupBy("tenant_id", "event_date").agg(F.count(F.lit(1)).alias("purchases"))
    v = t.page_view.groupBy("tenant_id", "event_date").agg(F.count_distinct(SESSION).alias("visitors"))
    j = v.join(p, ["tenant_id", "event_date"], "left")
    pur = F.coalesce(F.col("purchases"), F.lit(0))
    return j.select("tenant_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
                    F.when(F.col("visitors") > 0,
                           F.round(pur.cast("decimal(38,10)") / F.col("visitors") * 100, 2))
                    .otherwise(F.lit(0)).cast("double").alias("conversion_rate"))


# ---------------------------------------------------------------- windows / sorts
def purchase_totals(t: Tables) -> DataFrame:
    """Per-tenant total next to every row, as grouped count + join."""
    return with_total_count(t.purchase.select("tenant_id", "event_id")).select("tenant_id", "event_id", "total_count")


def top_purchases_per_day(t: Tables, n: int = 3) -> DataFrame:
    """Top-n purchases by revenue per (tenant, day), ties by event id."""
    r = take_page(t.purchase, [F.col("ecommerce_purchase_revenue").desc_nulls_last(), F.col("event_id").asc()],
                  1, n, by=["tenant_id", "event_date"], position="rank")
    return r.select("tenant_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), "event_id",
                    text.money(F.col("ecommerce_purchase_revenue")).alias("revenue"), "rank")


def cart_sessions(t: Tables) -> DataFrame:
    """SELECT DISTINCT (tenant, session) of cart events."""
    return distinct_sessions(t.add_to_cart)


# ---------------------------------------------------------------- scalar functions
def event_times(t: Tables) -> DataFrame:
    """Epoch-micro text to date; bucket starts and labels of every granularity."""
    ts = timebucket.micros_to_ts(F.col("event_timestamp"))
    cols = [F.col("tenant_id"), F.col("event_id"), timebucket.micros_to_date_text(F.col("event_timestamp"))
            .alias("event_day")]
    for g in timebucket.GRANULARITIES:
        start = timebucket.bucket_start(ts, g)
        cols.append(F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias(f"start_{g}"))
        cols.append(timebucket.bucket_label(start, g).alias(f"label_{g}"))
    return t.page_view.filter(digits_only(F.col("event_timestamp"))).select(*cols)


def data_spine(t: Tables, granularity: str = "4hours") -> DataFrame:
    """Bucket spine per tenant over the tenant's own first..last event day."""
    r = t.page_view.groupBy("tenant_id").agg(F.min("event_date").alias("s"), F.max("event_date").alias("e"))
    step = timebucket.SPINE_STEP_HOURS[granularity]
    pts = F.sequence(F.col("s").cast("timestamp"),
                     F.col("e").cast("timestamp") + F.expr("INTERVAL 23 HOURS 59 MINUTES 59 SECONDS"),
                     F.expr(f"INTERVAL {step} HOURS"))
    sp = r.select("tenant_id", F.explode(pts).alias("p"))
    start = timebucket.bucket_start(F.col("p"), granularity)
    return sp.select("tenant_id", timebucket.bucket_label(start, granularity).alias("date_group")).distinct()


def report_dates(t: Tables) -> DataFrame:
    """``TO_DATE(text, 'YYYY-MM-DD')`` round trip of the send-history report dates."""
    txt = F.date_format("report_date", "yyyy-MM-dd")
    return t.email_send_history.select("id", txt.alias("report_text"),
                                       F.datediff(F.to_date(txt, "yyyy-MM-dd"), F.lit("2000-01-01")).cast("bigint").alias("days"))


def currency_round_trip(t: Tables) -> DataFrame:
    """S8: '$' labels parsed back to numbers (bad text skipped) and formatted '$1,234.56'."""
    lab = revenue_per_day(t)
    v = text.parse_currency(F.col("revenue_label"))
    return lab.select("tenant_id", "event_date", v.alias("parsed"), text.format_currency(v).alias("formatted"))


def null_defaults(t: Tables) -> DataFrame:
    """COALESCE defaults of the worklists."""
    return t.purchase.select("tenant_id", "event_id",
                             F.coalesce(F.col("param_page_location"), F.lit("")).alias("page_location"),
                             text.money(F.coalesce(F.col("ecommerce_purchase_revenue"), F.lit(0))).alias("order_value"),
                             F.coalesce(F.col("items_json"), F.lit("[]")).alias("products"))


def raw_lookups(raw: DataFrame) -> DataFrame:
    """key/value lookups, first item and JSON text on the nested export."""
    up, ep = F.col("user_properties"), F.col("event_params")
    return raw.select("tenant_id", "event_timestamp", "event_name",
                      kv_int_first(up, "WebUserId").alias("webuserid"),
                      kv_int_first(ep, "ga_session_id").alias("session_id"),
                      kv_string_first(ep, "page_title").alias("page_title"),
                      kv_string_first(up, "default_branch_id").alias("branch"),
                      first_item(F.col("items"), "item_id").alias("first_item_id"),
                      F.size("items").alias("items"),
                      to_json_keep_nulls(F.col("device")).alias("device_json"))


def parsed_purchase_products(t: Tables) -> DataFrame:
    """Product JSON parsed with defaults (quantity 1, name 'Unknown', id '')."""
    from sessionscope.plans.report import parse_products
    return t.purchase.select("tenant_id", "event_id", F.array_join(parse_products(F.col("items_json")), ";")
                             .alias("products"))


def job_durations(t: Tables) -> DataFrame:
    """Duration labels of ingestion jobs."""
    return t.processing_jobs.select("tenant_id", "job_id",
                                    text.duration_label(F.col("started_at"), F.col("completed_at")).alias("duration"))


def visit_age_labels(t: Tables, as_of: str) -> DataFrame:
    """Today / Yesterday / N days ago of every page-view day."""
    return t.page_view.select("tenant_id", "event_date").distinct().select(
        "tenant_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        text.days_ago_label(F.col("event_date"), F.lit(as_of)).alias("label"))


def product_skus(t: Tables) -> DataFrame:
    """sku = last path segment of product page urls."""
    return t.page_view.select("tenant_id", "event_id", text.url_last_segment(F.col("param_page_location")).alias("sku"))
