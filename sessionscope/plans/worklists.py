"""Sales worklists Q4-Q10: purchases, abandoned carts, searches, repeat visits,
bounced sessions (+ top bounced pages and facets).

Common shape: scope the event table (pushed to the scan), aggregate per session,
resolve the customer (J1 equi-join rewrite), attach the per-tenant total (W1),
sort (L1) and optionally cut a page (L2) per tenant. ``tenant_id=None`` runs the
worklist for every tenant in one job.

Per-session item lists are built from rows pre-aggregated to distinct
(session, item) tuples with a multiplicity ``times``, so a hot session never
ships its raw rows to one task; the list is a faithful multiset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.functions.text import money, search_type_label
from sessionscope.functions.timebucket import micros_to_date_text
from sessionscope.operators.filters import any_ilike, ilike_contains, scope, tenant_filter
from sessionscope.operators.identity import USER_COLUMNS, resolve_users
from sessionscope.operators.paging import paged_with_total, sort_spec, take_page, with_total_count
from sessionscope.operators.sessions import SESSION, in_sessions, without_purchase
from sessionscope.sources.fixtures import Tables

USER = "user_prop_webuserid"
ERP = "user_prop_webcustomerid"

# Sort whitelists of the reference API (field name -> output column).
PURCHASE_SORTS = {"event_timestamp": "event_timestamp", "order_value": "ecommerce_purchase_revenue",
                  "customer_name": "customer_name"}
CART_SORTS = {"total_value": "total_value", "last_activity": "last_activity",
              "customer_name": "customer_name", "items_count": "items_count"}
SEARCH_SORTS = {"search_count": "search_count", "search_term": "search_term"}
REPEAT_SORTS = {"page_views_count": "page_views_count", "last_activity": "last_activity"}
BOUNCE_SORTS = {"last_activity": "last_activity", "customer_name": "customer_name",
                "entry_page": "entry_page"}


def _order(sort_field, sort_order, mapping, fallback, ties):
    col = mapping.get(sort_field)
    return sort_spec(col, sort_order, list(mapping.values()), fallback, ties)


def _finish(df: DataFrame, order: list[Column], page, limit, out_cols: list, part: list[str],
            totals: bool = True, single: bool = False) -> DataFrame:
    """Attach per-partition totals (W1) and page per partition (tenant [+ extra keys])
    when ``limit`` is given (keeps ``row_num``), else the whole sorted list. Pages are
    cut before the totals are joined, so only page rows are joined."""
    out_cols = [*part[1:], *out_cols]
    if limit is not None:
        paged = paged_with_total(df, order, page, limit, by=part, single_group=single) if totals \
            else take_page(df, order, page, limit, by=part, single_group=single)
        return paged.select(*out_cols, "row_num")
    d = with_total_count(df, by=part) if totals else df
    return d.orderBy(*part, *order).select(*out_cols)


def _total(totals: bool) -> list[Column]:
    return [F.col("total_count")] if totals else []


def _user_out() -> list[Column]:
    return [F.col(c) for c in USER_COLUMNS]


# ------------------------------------------------------------------ Q4
def purchase_tasks(t: Tables, tenant_id=None, page=None, limit=None, query=None, location_id=None,
                   start=None, end=None, sort_field="event_timestamp", sort_order="desc",
                   extra_keys=(), totals=True) -> DataFrame:
    """Q4: purchases with the resolved customer; fan-out rows are counted in the total.

    ``extra_keys`` (row columns such as the branch or event_date) split totals and
    pages further -- the worklist of every (branch, day) in one job."""
    part = ["tenant_id", *extra_keys]
    p = scope(t.purchase, tenant_id, location_id, start, end)
    if query is not None:
        p = p.filter(ilike_contains(F.col("items_json"), query))          # P7
    p = p.select(*part, "event_id", "param_transaction_id", "event_timestamp",
                 "ecommerce_purchase_revenue", SESSION, USER, ERP, "items_json", "param_page_location")
    d = resolve_users(p, tenant_filter(t.users, tenant_id), salt=["event_id"])
    order = _order(sort_field, sort_order, PURCHASE_SORTS, "event_timestamp", ["event_id", "user_id"])
    out = [
        F.col("tenant_id"),
        F.col("param_transaction_id").alias("transaction_id"),
        micros_to_date_text(F.col("event_timestamp")).alias("event_date"),
        money(F.coalesce(F.col("ecommerce_purchase_revenue"), F.lit(0))).alias("order_value"),
        F.coalesce(F.col("param_page_location"), F.lit("")).alias("page_location"),
        F.col(SESSION).alias("ga_session_id"),
        *_user_out(),
        F.coalesce(F.col("items_json"), F.lit("[]")).alias("products"),
        F.lit(False).alias("completed"),
        *_total(totals),
    ]
    return _finish(d, order, page, limit, out, part, totals, single=tenant_id is not None and not extra_keys)


# ------------------------------------------------------------------ Q5
def _multiset(tuple_cols: list[Column], keys: list[str], df: DataFrame, name: str) -> DataFrame:
    """Per ``keys``: sorted array of distinct item tuples with their multiplicity."""
    item = F.struct(*tuple_cols).alias("_item")
    per_item = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("times"))
    return per_item.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_item"), F.col("times")))).alias(name))


def items_text(arr: Column, fields: list[str]) -> Column:
    """Canonical text of an item multiset: ``f1|f2|...xN`` entries joined by ``;``."""
    def one(e):
        parts = [F.coalesce(e["_item"][f].cast("string"), F.lit("")) for f in fields]
        return F.concat(F.concat_ws("|", *parts), F.lit("x"), e["times"].cast("string"))
    return F.array_join(F.array_sort(F.transform(arr, one)), ";")


CART_ITEM_FIELDS = ["item_id", "item_name", "item_category", "price", "quantity"]


def cart_abandonment_tasks(t: Tables, tenant_id=None, page=None, limit=None, query=None,
                           location_id=None, start=None, end=None, sort_field="last_activity",
                           sort_order="desc", extra_keys=(), keep_arrays=False,
                           with_products=True, totals=True) -> DataFrame:
    """Q5: one row per (abandoned session, user). Step 2 reads *all* cart rows of the
    session -- date and branch filters only select which sessions qualify."""
    part = ["tenant_id", *extra_keys]
    users = tenant_filter(t.users, tenant_id)
    ac = scope(t.add_to_cart, tenant_id, location_id, start, end)
    ac = without_purchase(ac.select(*part, "event_id", SESSION, USER, ERP, "first_item_item_name"),
                          t.with_purchase(), salt=["event_id"])
    if query is not None:
        r = resolve_users(ac, users, salt=["event_id"])
        ac = r.filter(any_ilike([F.col("customer_name"), F.col("email"), F.col("first_item_item_name")], query))
    abandoned = ac.select(*part, SESSION).filter(F.col(SESSION).isNotNull()).distinct()
    all_rows = tenant_filter(t.add_to_cart, tenant_id).drop(*extra_keys)
    rows = all_rows.join(abandoned, ["tenant_id", SESSION], "inner") if extra_keys \
        else in_sessions(all_rows, abandoned)
    keys = [*part, SESSION, USER]
    value = F.col("first_item_price") * F.col("first_item_quantity")
    if with_products:
        # one chain: per (session, user, item) partials, rolled up per (session, user);
        # max / count / sum combine exactly, and the items become the multiset
        item = F.struct(F.col("first_item_item_id").alias("item_id"),
                        F.col("first_item_item_name").alias("item_name"),
                        F.col("first_item_item_category").alias("item_category"),
                        F.col("first_item_price").alias("price"),
                        F.col("first_item_quantity").alias("quantity")).alias("_item")
        per_item = rows.groupBy(*keys, item).agg(
            F.max(ERP).alias(ERP), F.max("event_timestamp").alias("last_activity"),
            F.count("event_id").alias("items_count"), F.sum(value).alias("total_value"),
            F.count(F.lit(1)).alias("times"))
        sd = per_item.groupBy(*keys).agg(
            F.max(ERP).alias(ERP), F.max("last_activity").alias("last_activity"),
            F.sum("items_count").alias("items_count"), F.sum("total_value").alias("total_value"),
            F.array_sort(F.collect_list(F.struct(F.col("_item"), F.col("times")))).alias("products"))
    else:
        sd = rows.groupBy(*keys).agg(
            F.max(ERP).alias(ERP),
            F.max("event_timestamp").alias("last_activity"),
            F.count("event_id").alias("items_count"),
            F.sum(value).alias("total_value"),
        ).withColumn("products", F.lit(None).cast(
            "array<struct<_item:struct<item_id:string,item_name:string,item_category:string,"
            "price:decimal(10,2),quantity:int>,times:bigint>>"))
    d = resolve_users(sd, users, salt=keys[:-1])
    order = _order(sort_field, sort_order, CART_SORTS, "last_activity", [SESSION, USER, "user_id"])
    date_txt = micros_to_date_text(F.col("last_activity"))
    out = [
        F.col("tenant_id"), F.col(SESSION).alias("session_id"),
        date_txt.alias("event_date"), date_txt.alias("last_activity"),
        F.col("items_count"), money(F.col("total_value")).alias("total_value"),
        *_user_out(),
        (F.col("products") if keep_arrays else items_text(F.col("products"), CART_ITEM_FIELDS)).alias("products"),
        *_total(totals),
    ]
    return _finish(d, order, page, limit, out, part, totals, single=tenant_id is not None and not extra_keys)


# ------------------------------------------------------------------ Q6
def _search_parts(t: Tables, tenant_id, query, location_id, start, end, include_converted, extra_keys=()):
    keys = ["tenant_id", *extra_keys, SESSION, USER]
    nsr = scope(t.no_search_results, tenant_id, location_id, start, end)
    if query is not None:
        nsr = nsr.filter(ilike_contains(F.col("param_no_search_results_term"), query))
    failed = nsr.groupBy(*keys, F.col("param_no_search_results_term").alias("search_term")).agg(
        F.max(ERP).alias(ERP), F.count(F.lit(1)).alias("search_count"),
        F.max("event_timestamp").alias("last_activity")).withColumn("search_type", F.lit("no_results"))
    vsr = scope(t.view_search_results, tenant_id, location_id, start, end)
    if query is not None:
        vsr = vsr.filter(ilike_contains(F.col("param_search_term"), query))
    if not include_converted:
        vsr = without_purchase(vsr, t.with_purchase(), salt=["event_id"])
    terms = F.array_join(F.array_sort(F.collect_set("param_search_term")), ", ")
    unconverted = (vsr.groupBy(*keys).agg(
        F.max(ERP).alias(ERP), terms.alias("search_term"), F.count(F.lit(1)).alias("search_count"),
        F.max("event_timestamp").alias("last_activity"))
        .filter(F.col("search_count") > 2)                                    # A6
        .withColumn("search_term", F.when(F.col("search_term") != "", F.col("search_term")))  # A10
        .withColumn("search_type", F.lit("no_conversion")))
    return failed.unionByName(unconverted)                                    # U2


def search_analysis_tasks(t: Tables, tenant_id=None, page=None, limit=None, query=None,
                          location_id=None, start=None, end=None, include_converted=False,
                          sort_field="search_count", sort_order="desc", search_type=None,
                          extra_keys=(), totals=True) -> DataFrame:
    """Q6: failed searches per (session, user, term) and unconverted search sessions."""
    part = ["tenant_id", *extra_keys]
    s = _search_parts(t, tenant_id, query, location_id, start, end, include_converted, extra_keys)
    if search_type is not None:
        s = s.filter(F.col("search_type") == search_type)
    d = resolve_users(s, tenant_filter(t.users, tenant_id), salt=[*part, SESSION, "search_term"])
    order = _order(sort_field, sort_order, SEARCH_SORTS, "last_activity",
                   [SESSION, USER, "search_type", "search_term", "user_id"])
    out = [
        F.col("tenant_id"), F.col(SESSION).alias("session_id"),
        micros_to_date_text(F.col("last_activity")).alias("event_date"),
        "search_term", "search_type", "search_count", *_user_out(), *_total(totals),
    ]
    return _finish(d, order, page, limit, out, part, totals, single=tenant_id is not None and not extra_keys)


def search_facets(t: Tables, tenant_id=None, query=None, location_id=None, start=None, end=None,
                  include_converted=False) -> DataFrame:
    """Q6 facets (A13): rows per search type, counted before the search_type filter."""
    s = _search_parts(t, tenant_id, query, location_id, start, end, include_converted)
    return (s.groupBy("tenant_id", "search_type").agg(F.count(F.lit(1)).alias("count"))
            .filter(F.col("count") > 0)
            .select("tenant_id", F.col("search_type").alias("value"),
                    search_type_label(F.col("search_type")).alias("label"), "count"))


# ------------------------------------------------------------------ Q7
PRODUCT_FIELDS = ["title", "url", "category", "price"]


def _repeat_sessions(t: Tables, tenant_id, location_id, start, end, extra_keys=()) -> DataFrame:
    part = ["tenant_id", *extra_keys]
    pv = scope(t.page_view, tenant_id, location_id, start, end)
    active = pv.groupBy(*part, SESSION, USER).agg(
        F.max(ERP).alias(ERP),
        F.count_distinct("param_page_location").alias("page_views_count"),
        F.max("event_timestamp").alias("last_activity")).filter(F.col("page_views_count") > 2)
    # J4 in one pass: sessions counted over their user (rows without a user or key drop out first, as in an
    # inner join, so no window holds more than one user's sessions)
    per_user = Window.partitionBy(*part, USER)
    return (active.dropna(subset=[*part, USER]).withColumn("_sessions", F.count(SESSION).over(per_user))
            .filter(F.col("_sessions") > 1).drop("_sessions"))


def _viewed_items(t: Tables, tenant_id) -> DataFrame:
    """view_item rows as (tenant, session, item id, displayed product)."""
    vi = tenant_filter(t.view_item, tenant_id).filter(
        F.col("first_item_item_id").isNotNull() & F.col(SESSION).isNotNull())
    return vi.select("tenant_id", SESSION, "first_item_item_id", F.struct(
        F.coalesce("first_item_item_name", "first_item_item_id").alias("title"),
        F.col("param_page_location").alias("url"),
        F.col("first_item_item_category").alias("category"),
        F.col("first_item_price").alias("price")).alias("_item"))


def _roll_products(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: number of item ids and distinct products, from one chain (distinct (item id, product) rows first)."""
    per_id = items.groupBy(*keys, "first_item_item_id").agg(F.collect_set("_item").alias("_items"))
    return per_id.groupBy(*keys).agg(
        F.count("first_item_item_id").alias("products_viewed"),
        F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))),
                    lambda x: F.struct(x.alias("_item"), F.lit(1).alias("times"))).alias("products_details"))


def session_products(t: Tables, sessions: DataFrame | None, tenant_id=None) -> DataFrame:
    """J8 + A9: distinct products viewed per session (optionally only the given sessions)."""
    items = _viewed_items(t, tenant_id)
    return _roll_products(items if sessions is None else in_sessions(items, sessions), ["tenant_id", SESSION])


def enrich_page(page: DataFrame, t: Tables, tenant_id=None) -> DataFrame:
    """J8 on a page: its rows join the product views of their sessions first, and only those are rolled up, by page
    row. The page is planned once, and view_item is never aggregated as a whole."""
    rows = page.join(_viewed_items(t, tenant_id), ["tenant_id", SESSION], "left")
    rolled = _roll_products(rows, page.columns)
    return rolled.withColumn("products_details", F.when(F.col("products_viewed") > 0, F.col("products_details")))


def repeat_visit_tasks(t: Tables, tenant_id=None, page=None, limit=None, query=None, location_id=None,
                       start=None, end=None, sort_field="page_views_count", sort_order="desc",
                       extra_keys=(), keep_arrays=False, with_products=True, totals=True) -> DataFrame:
    """Q7: sessions with >2 distinct pages of users having >1 such session, with the
    products they viewed. Paging happens before the product enrichment."""
    part = ["tenant_id", *extra_keys]
    rvs = _repeat_sessions(t, tenant_id, location_id, start, end, extra_keys)
    r = resolve_users(rvs, tenant_filter(t.users, tenant_id), salt=[*part, SESSION])
    if query is not None:
        r = r.filter(any_ilike([F.col("customer_name"), F.col("email")], query))
    order = _order(sort_field, sort_order, REPEAT_SORTS, "last_activity", [SESSION, USER, "user_id"])
    single = tenant_id is not None and not extra_keys
    if limit is None:
        d = with_total_count(r, by=part) if totals else r
    elif totals:
        d = paged_with_total(r, order, page, limit, by=part, single_group=single)
    else:
        d = take_page(r, order, page, limit, by=part, single_group=single)
    if not with_products:
        e = d.withColumn("products_viewed", F.lit(None).cast("bigint")).withColumn(
            "products_details", F.lit(None).cast(
                "array<struct<_item:struct<title:string,url:string,category:string,price:decimal(10,2)>,times:int>>"))
    elif limit is not None:
        e = enrich_page(d, t, tenant_id)
    else:
        e = d.join(session_products(t, None, tenant_id), ["tenant_id", SESSION], "left")
    out = [
        F.col("tenant_id"), *extra_keys, F.col(SESSION).alias("session_id"),
        micros_to_date_text(F.col("last_activity")).alias("event_date"),
        "page_views_count",
        F.coalesce(F.col("products_viewed"), F.lit(0)).cast("bigint").alias("products_viewed"),
        (F.col("products_details") if keep_arrays
         else F.coalesce(items_text(F.col("products_details"), PRODUCT_FIELDS), F.lit(""))).alias("products_details"),
        *_user_out(), *_total(totals),
    ]
    if limit is not None:
        return e.select(*out, "row_num")
    return e.orderBy(*part, *order).select(*out)


# ------------------------------------------------------------------ Q8-Q10
def bounced_sessions(t: Tables, tenant_id=None, location_id=None, start=None, end=None) -> DataFrame:
    """Sessions (per user) with exactly one distinct page; entry page = first by time."""
    pv = scope(t.page_view, tenant_id, location_id, start, end)
    spc = pv.groupBy("tenant_id", SESSION, USER).agg(
        F.max(ERP).alias(ERP),
        F.max("user_prop_default_branch_id").alias("location_id"),
        F.count_distinct("param_page_location").alias("page_view_count"),
        F.max("event_timestamp").alias("last_activity"),
        F.min_by("param_page_location", F.struct("event_timestamp", "event_id")).alias("entry_page"))
    return spc.filter(F.col("page_view_count") == 1)


def performance_bounced_sessions(t: Tables, tenant_id=None, page=None, limit=None, location_id=None,
                                 start=None, end=None, sort_field="last_activity",
                                 sort_order="desc") -> DataFrame:
    """Q8: bounced sessions; the total is counted *before* the user join (reference rule)."""
    b = bounced_sessions(t, tenant_id, location_id, start, end)
    # the total counts bounced sessions *before* the user join (reference rule)
    d = resolve_users(with_total_count(b), tenant_filter(t.users, tenant_id), salt=["tenant_id", SESSION])
    order = _order(sort_field, sort_order, BOUNCE_SORTS, "last_activity", [SESSION, USER, "user_id"])
    out = [
        F.col("tenant_id"), F.col(SESSION).alias("session_id"),
        micros_to_date_text(F.col("last_activity")).alias("event_date"),
        "entry_page", *_user_out(), "total_count",
    ]
    return _finish(d, order, page, limit, out, ["tenant_id"], totals=False, single=tenant_id is not None)


def frequently_bounced_pages(t: Tables, tenant_id=None, location_id=None, start=None, end=None,
                             top: int = 10) -> DataFrame:
    """Q9 (L4): top entry pages by bounces per tenant (ties broken by page)."""
    c = bounced_sessions(t, tenant_id, location_id, start, end).groupBy("tenant_id", "entry_page").agg(
        F.count(F.lit(1)).alias("bounce_count"))
    ranked = take_page(c, [F.col("bounce_count").desc(), F.col("entry_page").asc_nulls_first()], 1, top,
                       position="rank")
    return ranked.select("tenant_id", "entry_page", "bounce_count", "rank")


def performance_facets(t: Tables, tenant_id=None, location_id=None, start=None, end=None,
                       top: int = 10) -> DataFrame:
    """Q10: high_bounce (#bounced sessions) and page_bounce_issue (#top pages), only
    when > 0, ordered by the count *as text* descending (reference quirk).

    Both facets come from one count per (tenant, entry page): the bounced sessions
    are its sum, and the top-``top`` list (Q9) has ``least(#pages, top)`` rows."""
    per_page = bounced_sessions(t, tenant_id, location_id, start, end).groupBy("tenant_id", "entry_page").agg(
        F.count(F.lit(1)).alias("bounces"))
    per_tenant = per_page.groupBy("tenant_id").agg(F.sum("bounces").alias("high"),
                                                   F.count(F.lit(1)).alias("pages"))
    facet = lambda v, label, n: F.struct(F.lit(v).alias("value"), F.lit(label).alias("label"),
                                         n.cast("bigint").alias("count"))
    f = (per_tenant.select("tenant_id", F.explode(F.array(
            facet("high_bounce", "High Bounce", F.col("high")),
            facet("page_bounce_issue", "Page Bounce", F.least(F.col("pages"), F.lit(top))))).alias("_f"))
         .select("tenant_id", "_f.*").filter(F.col("count") > 0))
    return take_page(f, [F.col("count").cast("string").desc(), F.col("value").asc()], None, None,
                     position="position")
