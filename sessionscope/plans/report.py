"""Daily branch report datasets (R1-R9) and dashboard rules.

The reference builds one report per branch and day in a loop over worklist pages.
Here every (tenant, branch, report day) is a key of one grouped job: each worklist
runs once with ``extra_keys=[branch, event_date]``, and the roll-ups are plain
aggregations over all of its rows. The sample lists (R5, R7, R8) take all rows too,
or the first ``rows`` of each key where the caller asks for a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.text import url_last_segment
from sessionscope.operators.filters import optional_eq, tenant_filter
from sessionscope.operators.paging import take_page
from sessionscope.plans import worklists as W
from sessionscope.sources.fixtures import Tables

# Fixed values of the report: sample sizes and subject.
TOP_TERMS = 10
TOP_PRODUCTS = 5
SUBJECT = "Daily Branch Sales Report - {date} - {branch}"
BRANCH, DAY = "report_branch", "report_day"
KEYS = ["tenant_id", BRANCH, DAY]


def _with_report_keys(t: Tables) -> Tables:
    """Event tables carrying the report keys (branch, day) under their own names."""
    return t.with_events(lambda df: df.withColumn(BRANCH, F.col("user_prop_default_branch_id")).withColumn(DAY, F.col("event_date")))


def report_keys(per_day: bool = True) -> list[str]:
    return ["tenant_id", BRANCH, DAY] if per_day else ["tenant_id", BRANCH]


def report_worklist(name: str, t: Tables, tenant_id=None, report_date: str | None = None,
                    per_day: bool = True, with_products: bool = True, rows: int | None = None) -> DataFrame:
    """One of the four worklists (``purchases``, ``carts``, ``searches``, ``repeats``) keyed by
    (tenant, branch[, day]); ``per_day=False`` reports each branch over the whole period, ``rows`` cuts each key to
    its first rows."""
    t = _with_report_keys(t)
    kw = dict(tenant_id=tenant_id, start=report_date, end=report_date, extra_keys=report_keys(per_day)[1:],
              totals=False, **(dict(page=1, limit=rows) if rows is not None else {}))
    if name == "purchases":
        return W.purchase_tasks(t, **kw)
    if name == "carts":
        return W.cart_abandonment_tasks(t, keep_arrays=True, with_products=with_products, **kw)
    if name == "searches":
        return W.search_analysis_tasks(t, **kw)
    return W.repeat_visit_tasks(t, keep_arrays=True, with_products=with_products, **kw)


def _distinct_nonempty(c: str) -> Column:
    return F.count_distinct(F.when(F.col(c) != "", F.col(c)))


def _avg(num: Column, den: Column) -> Column:
    """``num / max(den, 1)`` in double precision (as the reference's Python does)."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")


def purchase_rollup(p: DataFrame, keys=KEYS) -> DataFrame:
    """R2: totals, revenue, unique customers, average order."""
    rev = F.sum(F.col("order_value").cast("decimal(20,2)"))
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_purchases"),
        rev.cast("double").alias("total_revenue"),
        _distinct_nonempty("user_id").alias("purchase_unique_customers"),
        _avg(rev, F.count(F.lit(1))).alias("avg_order_value"))


def cart_rollup(c: DataFrame, keys=KEYS) -> DataFrame:
    """NULL cart values count as 0."""
    v = F.sum(F.coalesce(F.col("total_value"), F.lit(0)).cast("decimal(20,2)"))
    return c.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_cart_abandonment"),
        _distinct_nonempty("user_id").alias("cart_unique_customers"),
        v.cast("double").alias("cart_total_value"),
        _avg(v, F.count(F.lit(1))).alias("cart_avg_value"))


def search_rollup(s: DataFrame, keys=KEYS) -> DataFrame:
    """Task rows (reported as unique terms), searches, sessions, users."""
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_search_issues"),
        F.sum("search_count").cast("bigint").alias("search_total_searches"),
        _distinct_nonempty("session_id").alias("search_affected_sessions"),
        _distinct_nonempty("user_id").alias("search_unique_users"))


def repeat_rollup(r: DataFrame, keys=KEYS) -> DataFrame:
    """Average pages = sum / max(total, 1)."""
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_repeat_visits"),
        _avg(F.sum("page_views_count"), F.count(F.lit(1))).alias("repeat_avg_pages"))


ROLLUPS = {
    "purchases": (purchase_rollup, ["total_purchases", "total_revenue", "purchase_unique_customers", "avg_order_value"]),
    "carts": (cart_rollup, ["total_cart_abandonment", "cart_unique_customers", "cart_total_value", "cart_avg_value"]),
    "searches": (search_rollup, ["total_search_issues", "search_total_searches", "search_affected_sessions", "search_unique_users"]),
    "repeats": (repeat_rollup, ["total_repeat_visits", "repeat_avg_pages"]),
}


def branch_rollup(name: str, t: Tables, tenant_id=None, report_date: str | None = None, per_day: bool = True) -> DataFrame:
    """R2, R3, R4 or R6 by itself: one roll-up of one worklist per (tenant, branch[, day]) that has a row in it."""
    rollup, columns = ROLLUPS[name]
    g = rollup(report_worklist(name, t, tenant_id, report_date, per_day, with_products=False), report_keys(per_day))
    return g.select("tenant_id", F.col(BRANCH).alias("branch_code"), *_day_out(per_day),
                    *[F.col(c).cast(ROLLUP_COLUMNS[c]).alias(c) for c in columns])


ROLLUP_COLUMNS = {
    "total_purchases": "bigint", "total_revenue": "double", "purchase_unique_customers": "bigint",
    "avg_order_value": "double", "total_cart_abandonment": "bigint", "cart_unique_customers": "bigint",
    "cart_total_value": "double", "cart_avg_value": "double", "total_search_issues": "bigint",
    "search_total_searches": "bigint", "search_affected_sessions": "bigint", "search_unique_users": "bigint",
    "total_repeat_visits": "bigint", "repeat_avg_pages": "double",
}


def _day_out(per_day: bool) -> list[Column]:
    return [F.date_format(DAY, "yyyy-MM-dd").alias("report_date")] if per_day else []


def branch_report_summary(t: Tables, tenant_id=None, report_date: str | None = None,
                          per_day: bool = True) -> DataFrame:
    """One row per (tenant, branch, report day) having any worklist row, with the
    location's display fields; the four roll-ups side by side, zero-filled."""
    keys = report_keys(per_day)
    parts = [rollup(report_worklist(name, t, tenant_id, report_date, per_day, with_products=False), keys)  # no item lists needed
             for name, (rollup, _) in ROLLUPS.items()]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    g = u.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ROLLUP_COLUMNS])
    loc = tenant_filter(t.locations, tenant_id).select(
        "tenant_id", F.col("warehouse_code").alias(BRANCH), F.col("warehouse_name").alias("location_name"),
        "city", "state")
    j = g.join(loc, ["tenant_id", BRANCH], "left")
    return j.select(
        "tenant_id", F.col(BRANCH).alias("branch_code"), *_day_out(per_day),
        "location_name", "city", "state",
        *[F.coalesce(F.col(c), F.lit(0)).cast(tp).alias(c) for c, tp in ROLLUP_COLUMNS.items()])


def search_term_samples(t: Tables, tenant_id=None, report_date=None, per_day: bool = True, rows: int | None = None) -> DataFrame:
    """Per term of the search tasks: task rows, distinct sessions and the
    contacts of rows with a customer; top 10 terms per (tenant, branch, day).

    Terms are ranked by their counts alone. Contacts are listed afterwards, of the rows whose term was kept: the ranked terms
    join the task rows with a customer, so no list of a dropped term is ever built."""
    keys = report_keys(per_day)
    s = report_worklist("searches", t, tenant_id, report_date, per_day, rows=rows)
    g = s.groupBy(*keys, "search_term").agg(F.count(F.lit(1)).alias("total_searches"), _distinct_nonempty("session_id").alias("unique_sessions"))
    top = take_page(g, [F.col("total_searches").desc(), F.col("search_term").asc_nulls_first()], 1, TOP_TERMS,
                    by=keys, position="rank")
    contact = F.concat_ws("|", F.col("customer_name"), F.coalesce("email", F.lit("")), F.coalesce("phone", F.lit("")))
    named = s.filter(F.col("customer_name") != "").select(*keys, "search_term", contact.alias("contact")).alias("named")
    same = reduce(lambda x, y: x & y, [F.col(f"top.{c}").eqNullSafe(F.col(f"named.{c}")) for c in [*keys, "search_term"]])
    listed = (top.alias("top").join(named, same, "left").groupBy(*[F.col(f"top.{c}").alias(c) for c in top.columns])
              .agg(F.array_join(F.array_sort(F.collect_list("named.contact")), ";").alias("user_details")))
    return listed.select("tenant_id", F.col(BRANCH).alias("branch_code"), *_day_out(per_day),
                         "search_term", "total_searches", "unique_sessions", "user_details", "rank")


def repeat_samples(t: Tables, tenant_id=None, report_date=None, per_day: bool = True, rows: int | None = None) -> DataFrame:
    """Per repeat visit: customer, e-mail, pages viewed and its first five
    products (title / url / category / price with display defaults)."""
    r = report_worklist("repeats", t, tenant_id, report_date, per_day, rows=rows)
    prods = F.transform(F.slice(F.coalesce(F.col("products_details"), F.array()), 1, TOP_PRODUCTS),
                        lambda e: F.concat_ws("|", F.coalesce(e["_item"]["title"], F.lit("Unknown Product")),
                                              F.coalesce(e["_item"]["url"], F.lit("#")),
                                              F.coalesce(e["_item"]["category"], F.lit("")),
                                              F.coalesce(e["_item"]["price"].cast("string"), F.lit("0"))))
    return r.select("tenant_id", F.col(BRANCH).alias("branch_code"), *_day_out(per_day), "session_id",
                    F.col("customer_name").alias("customer"), "email",
                    F.col("page_views_count").alias("pages_viewed"),
                    F.array_join(prods, ";").alias("pages_summary"))


ITEM_SCHEMA = "array<struct<item_id:string,item_name:string,quantity:bigint>>"


def parse_products(json_text: Column) -> Column:
    """JSON item list -> 'quantity x name (id)' entries with defaults 1 / Unknown / ''."""
    arr = F.coalesce(F.from_json(json_text, ITEM_SCHEMA), F.array())
    return F.transform(arr, lambda e: F.concat(
        F.coalesce(e["quantity"], F.lit(1)).cast("string"), F.lit("x "),
        F.coalesce(e["item_name"], F.lit("Unknown")), F.lit(" ("), F.coalesce(e["item_id"], F.lit("")), F.lit(")")))


def _phone() -> Column:
    return F.when(F.col("phone").isNotNull() & (F.col("phone") != ""), F.col("phone")).otherwise(F.col("office_phone"))


def purchase_and_cart_samples(t: Tables, tenant_id=None, report_date=None, per_day: bool = True,
                              rows: int | None = None) -> DataFrame:
    """Purchases and carts with contact phone (cell, else office) and the
    parsed product list."""
    keys = report_keys(per_day)
    purchases, carts = (report_worklist(n, t, tenant_id, report_date, per_day, rows=rows) for n in ("purchases", "carts"))
    p = purchases.select(
        *keys, F.lit("purchase").alias("kind"), F.col("transaction_id").alias("ref_id"),
        "customer_name", F.col("order_value").alias("value"), "email", _phone().alias("phone"),
        F.array_join(parse_products(F.col("products")), ";").alias("products"))
    # one entry per cart row: each distinct item tuple repeated by its multiplicity
    cart_items = F.flatten(F.transform(F.coalesce(F.col("products"), F.array()), lambda e: F.array_repeat(F.concat(
        F.coalesce(e["_item"]["quantity"].cast("string"), F.lit("1")), F.lit("x "),
        F.coalesce(e["_item"]["item_name"], F.lit("Unknown")), F.lit(" ("),
        F.coalesce(e["_item"]["item_id"], F.lit("")), F.lit(")")), e["times"].cast("int"))))
    c = carts.select(
        *keys, F.lit("cart").alias("kind"), F.col("session_id").alias("ref_id"),
        "customer_name", F.coalesce(F.col("total_value"), F.lit(0.0)).alias("value"), "email",
        _phone().alias("phone"), F.array_join(F.array_sort(cart_items), ";").alias("products"))
    return p.unionByName(c).select("tenant_id", F.col(BRANCH).alias("branch_code"), *_day_out(per_day),
                                   "kind", "ref_id",
                                   "customer_name", "value", "email", "phone", "products")


#: Parts that the e-mail jobs of a branch are dealt to. Branches are few and do not grow with the jobs, so the branch alone is no key to share the plan out by.
DISPATCH_PARTS = 64

#: Tasks a core that make the pairs, so that none of the last ones runs alone for long.
DISPATCH_TASKS = 32


def dispatch_plan(t: Tables, tenant_id=None, status: str | None = None) -> DataFrame:
    """R9 (J9): one row per e-mail job x enabled recipient of each target branch (all
    branches when the job names none), with the report subject and location name.

    The plan has a row for every pair of them, so all that depends on one side alone is made before they meet: the subject on the
    job, the location's name on the recipient. Jobs are dealt to parts, and every part has all recipients; a sort-merge
    join holds the recipients of one branch at a time, spilling them where they are many. The number of tasks is given: what the
    join reads is small beside its rows, and by that size alone AQE would make little more than one task a core."""
    spark = t.locations.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), DISPATCH_TASKS * spark.sparkContext.defaultParallelism)
    deal = lambda df, keys: df.repartition(tasks, *keys)
    part = F.pmod(F.xxhash64("job_id"), F.lit(DISPATCH_PARTS)).alias("_part")
    jobs = optional_eq(tenant_filter(t.email_sending_jobs, tenant_id), "status", status)
    loc = tenant_filter(t.locations, tenant_id).select(
        "tenant_id", F.col("warehouse_code").alias("branch_code"), F.col("warehouse_name").alias("location_name"))
    maps = (tenant_filter(t.branch_email_mappings, tenant_id).filter(F.col("is_enabled")).join(loc, ["tenant_id", "branch_code"], "left")
            .select("tenant_id", "branch_code", "sales_rep_email", "sales_rep_name", "location_name",
                    F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(DISPATCH_PARTS - 1).cast("bigint"))).alias("_part")))
    subject = F.concat(F.lit("Daily Branch Sales Report - "), F.date_format("report_date", "yyyy-MM-dd"),
                       F.lit(" - "), F.col("branch_code")).alias("subject")
    out = ["tenant_id", "job_id", "branch_code", "sales_rep_email", "sales_rep_name", "subject", "location_name"]
    named = (jobs.select("tenant_id", "job_id", "report_date", part, F.explode("target_branches").alias("branch_code"))
             .select("tenant_id", "branch_code", "_part", "job_id", subject))
    unnamed = jobs.filter(F.coalesce(F.size("target_branches"), F.lit(0)) <= 0).select("tenant_id", "job_id", "report_date", part)
    by_branch, by_tenant = ["tenant_id", "branch_code", "_part"], ["tenant_id", "_part"]
    listed = deal(named, by_branch).hint("merge").join(deal(maps, by_branch), by_branch, "inner").select(*out)
    rest = deal(unnamed, by_tenant).hint("merge").join(deal(maps, by_tenant), by_tenant, "inner").withColumn("subject", subject).select(*out)
    return listed.unionByName(rest)


# ---------------------------------------------------------------- R11-R14 priorities
def _hours_since(day_text: Column, as_of: str) -> Column:
    return F.floor((F.unix_seconds(F.to_timestamp(F.lit(as_of)))
                    - F.unix_seconds(F.to_date(day_text).cast("timestamp"))) / 3600)


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def purchase_priority(value: Column, day_text: Column, as_of: str) -> Column:
    """High > 1000 or (> 500 and < 24 h old); low < 100 or > 168 h old; else medium."""
    v, h = F.coalesce(value, F.lit(0)), _hours_since(day_text, as_of)
    return (F.when((v > 1000) | _true((v > 500) & (h < 24)), "high")
            .when((v < 100) | _true(h > 168), "low").otherwise("medium"))


def cart_priority(value: Column, day_text: Column, as_of: str) -> Column:
    """High > 500 or (> 200 and < 24 h old); low < 50 or > 72 h old; else medium."""
    v, h = F.coalesce(value, F.lit(0)), _hours_since(day_text, as_of)
    return (F.when((v > 500) | _true((v > 200) & (h < 24)), "high")
            .when((v < 50) | _true(h > 72), "low").otherwise("medium"))


def repeat_priority(pages: Column, products: Column, day_text: Column, as_of: str) -> Column:
    """High (pages > 10 and products > 5) or (pages > 15 and < 3 days);
    medium pages > 5 or products > 2 or < 7 days; else low."""
    p, q = F.coalesce(pages, F.lit(0)), F.coalesce(products, F.lit(0))
    d = F.floor(_hours_since(day_text, as_of) / 24)
    return (F.when(((p > 10) & (q > 5)) | _true((p > 15) & (d < 3)), "high")
            .when((p > 5) | (q > 2) | _true(d < 7), "medium").otherwise("low"))


def search_priority(search_type: Column, count: Column) -> Column:
    """no_results: > 3 high, <= 1 low; otherwise > 5 high, <= 2 low; else medium."""
    n = F.coalesce(count, F.lit(0))
    nr = F.coalesce(search_type, F.lit("")) == "no_results"
    return (F.when(nr & (n > 3), "high").when(nr & (n <= 1), "low")
            .when(~nr & (n > 5), "high").when(~nr & (n <= 2), "low").otherwise("medium"))


# ---------------------------------------------------------------- R15
HISTORY_SECTIONS = {"purchases": 5, "carts": 5, "searches": 10, "viewed_products": 10}


DETAILS_SCHEMA = ("page_location string, page_title string, item_id string, item_name string, price decimal(10,2), quantity int, "
                  "transaction_id string, revenue decimal(15,2), items string, search_term string, category string")


def history_projection(timeline: DataFrame) -> DataFrame:
    """A user's timeline split into purchases (value = revenue, with their items), carts (value = price x quantity, with
    the item), searches (value = results 1 / 0) and viewed products (product pages and item views, with name, category
    and view count), keeping the first 5 / 5 / 10 / 10 of each in time order. A missing or empty text takes its
    default. The details are parsed once, into a typed struct."""
    d = lambda f: F.col(f"d.{f}")
    text = lambda c, default: F.when(c.isNotNull() & (c != ""), c).otherwise(F.lit(default))
    number = lambda c, kind="decimal(15,2)": F.coalesce(c, F.lit(0)).cast(kind)
    et, loc = F.col("event_type"), d("page_location")
    events = timeline.select("tenant_id", "user_id", "event_timestamp", "session_id", "event_type", "details",
                             F.from_json("details", DETAILS_SCHEMA).alias("d"))
    section = (F.when(et == "purchase", "purchases").when(et == "add_to_cart", "carts")
               .when(et.isin("view_search_results", "no_search_results"), "searches")
               .when(et == "view_item", "viewed_products")
               .when((et == "page_view") & _true(loc.contains("/product/")), "viewed_products"))
    key = (F.when(et == "purchase", text(d("transaction_id"), "unknown"))
           .when(et == "add_to_cart", text(F.col("session_id"), "unknown"))
           .when(et.isin("view_search_results", "no_search_results"), text(d("search_term"), "unknown"))
           .when(et == "view_item", text(d("item_id"), "unknown"))
           .otherwise(text(url_last_segment(loc), "unknown")))
    value = (F.when(et == "purchase", number(d("revenue")).cast("double"))
             .when(et == "add_to_cart", number(d("price")).cast("double") * number(d("quantity")).cast("double"))
             .when(et == "view_search_results", F.lit(1.0)).when(et == "no_search_results", F.lit(0.0))
             .when(et == "view_item", number(d("price")).cast("double")).otherwise(F.lit(0.0)))
    viewed = F.col("section") == "viewed_products"
    name = F.when(viewed, text(F.when(et == "page_view", d("page_title")).otherwise(d("item_name")), "Unknown Product"))
    category = F.when(viewed, F.when(et == "view_item", text(d("category"), "Product")).otherwise(F.lit("Product")))
    items = (F.when(et == "purchase", text(d("items"), "[]"))
             .when(et == "add_to_cart", F.concat_ws("|", text(d("item_name"), "Unknown Item"), text(d("item_id"), "unknown"),
                                                    number(d("quantity"), "int").cast("string"), number(d("price"), "decimal(10,2)").cast("string"))))
    day = F.date_format(F.timestamp_micros(F.col("event_timestamp").try_cast("bigint")), "yyyyMMdd")
    rows = events.withColumn("section", section).filter(F.col("section").isNotNull()).select(
        "tenant_id", "user_id", "section", "event_timestamp", "event_type", "details", day.alias("event_day"), key.alias("item_key"),
        name.alias("name"), category.alias("category"), F.round(value, 2).alias("value"), items.alias("items"), F.when(viewed, F.lit(1)).alias("view_count"))
    ranked = take_page(rows, [F.col("event_timestamp").asc(), F.col("event_type").asc(), F.col("details").asc()],
                       1, max(HISTORY_SECTIONS.values()), by=["tenant_id", "user_id", "section"], position="position")
    limit = reduce(lambda acc, kv: acc.when(F.col("section") == kv[0], F.lit(kv[1])),
                   HISTORY_SECTIONS.items(), F)
    return ranked.filter(F.col("position") <= limit).select(
        "tenant_id", "user_id", "section", "position", "event_timestamp", "event_day", "item_key", "name", "category", "value", "items", "view_count")
