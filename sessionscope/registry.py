"""Registered queries: ``QUERIES[key] = (spark_fn(spark, sf_dir) -> DataFrame, oracle SQL or None)``.

Every query runs over whole tables: all tenants at once (tenant is a grouping
key), the full event date range, no row caps except where a limit is the
feature itself (a page, a top-k report).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionscope.oracle import fixture_sql
from sessionscope.sources.fixtures import load_tables

# Fixed parameters of the registered queries: the whole fixture period.
START = "2024-01-01"
END = "2024-01-31"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(key: str, sql: str | None):
    def deco(fn):
        QUERIES[key] = (fn, sql)
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str):
    return load_tables(spark, sf_dir)


def _in_range(start: str = START, end: str = END) -> str:
    return f"event_date BETWEEN DATE '{start}' AND DATE '{end}'"


# ---------------------------------------------------------------- Q1
def q1_sql(where: str = _in_range()) -> str:
    """Every figure is a row (tenant, what, v); one conditional aggregation lays them side by side. Abandoned sessions
    are a set difference; repeat visitors are the users whose smallest and greatest session differ."""
    return fixture_sql(f"""
SELECT tenant_id,
       COALESCE('$' || MAX(v) FILTER (what = 'revenue')::VARCHAR, '$0') AS total_revenue,
       COALESCE(MAX(v) FILTER (what = 'purchases'), 0)::BIGINT AS purchases,
       COALESCE(MAX(v) FILTER (what = 'visitors'), 0)::BIGINT AS total_visitors,
       COALESCE(MAX(v) FILTER (what = 'users'), 0)::BIGINT AS unique_users,
       COALESCE(MAX(v) FILTER (what = 'abandoned'), 0)::BIGINT AS abandoned_carts,
       COALESCE(MAX(v) FILTER (what = 'searches'), 0)::BIGINT AS total_searches,
       COALESCE(MAX(v) FILTER (what = 'failed'), 0)::BIGINT AS failed_searches,
       COALESCE(MAX(v) FILTER (what = 'repeat'), 0)::BIGINT AS repeat_visits,
       COALESCE(round(COALESCE(MAX(v) FILTER (what = 'purchases'), 0)::DOUBLE
                      / nullif(MAX(v) FILTER (what = 'visitors'), 0)::DOUBLE * 100, 2), 0)::DOUBLE AS conversion_rate
FROM figures GROUP BY tenant_id
""", extra_ctes=f"""
figures(tenant_id, what, v) AS (
  SELECT tenant_id, 'revenue', SUM(ecommerce_purchase_revenue)::DECIMAL(38,2) FROM purchase WHERE {where} GROUP BY 1
  UNION ALL SELECT tenant_id, 'purchases', COUNT(*) FROM purchase WHERE {where} GROUP BY 1
  UNION ALL SELECT tenant_id, 'visitors', COUNT(DISTINCT param_ga_session_id) FROM page_view WHERE {where} GROUP BY 1
  UNION ALL SELECT tenant_id, 'users', COUNT(DISTINCT user_prop_webuserid) FROM page_view WHERE {where} GROUP BY 1
  UNION ALL SELECT tenant_id, 'abandoned', COUNT(param_ga_session_id) FROM (
    SELECT tenant_id, param_ga_session_id FROM add_to_cart WHERE {where}
    EXCEPT SELECT tenant_id, param_ga_session_id FROM purchase) GROUP BY 1
  UNION ALL SELECT tenant_id, 'searches', COUNT(*) FROM view_search_results WHERE {where} GROUP BY 1
  UNION ALL SELECT tenant_id, 'failed', COUNT(*) FROM no_search_results WHERE {where} GROUP BY 1
  UNION ALL SELECT tenant_id, 'repeat', COUNT(*) FILTER (lo < hi) FROM (
    SELECT tenant_id, MIN(param_ga_session_id) AS lo, MAX(param_ga_session_id) AS hi FROM page_view
    WHERE {where} AND user_prop_webuserid IS NOT NULL GROUP BY tenant_id, user_prop_webuserid) GROUP BY 1)
""")


Q1_SQL = q1_sql()


@register("q1_overview_stats", Q1_SQL)
def q1_overview_stats(spark, sf_dir):
    from sessionscope.plans.overview import overview_stats
    return overview_stats(tables(spark, sf_dir), START, END)


# ---------------------------------------------------------------- Q2
def _duck_bucket(ts: str, g: str) -> tuple[str, str]:
    """(bucket start, label) expressions in DuckDB for granularity ``g``."""
    if g == "monthly":
        s = f"date_trunc('month', {ts})"
        return s, f"strftime({s}, '%Y-%m-01')"
    if g == "weekly":
        s = f"date_trunc('week', {ts})"
        return s, f"strftime({s}, '%G-%V')"
    if g == "daily":
        s = f"date_trunc('day', {ts})"
        return s, f"strftime({s}, '%Y-%m-%d')"
    n = {"hourly": 1, "4hours": 4, "12hours": 12}[g]
    s = f"(date_trunc('hour', {ts}) - to_hours(CAST(hour({ts}) % {n} AS BIGINT)))"
    return s, f"strftime({s}, '%Y-%m-%d %H:00')"


def q2_sql(g: str, start: str = START, end: str = END) -> str:
    """Counted rows of all kinds carry (tenant, label, kind, session, revenue); one aggregation over the spine's
    buckets and the rows that fall into them gives every figure."""
    sub = g in ("hourly", "4hours", "12hours")
    step = {"hourly": "1 HOUR", "4hours": "4 HOUR", "12hours": "12 HOUR"}.get(g, "1 DAY")
    at = "make_timestamp(TRY_CAST(event_timestamp AS BIGINT))" if sub else "CAST(event_date AS TIMESTAMP)"
    label = _duck_bucket(at, g)[1]
    point, point_label = _duck_bucket("moment", g)
    where = _in_range(start, end) + (" AND regexp_full_match(event_timestamp, '[0-9]+')" if sub else "")
    rows = lambda kind, table, revenue="NULL", extra="": (
        f"SELECT tenant_id, {label} AS date_group, '{kind}' AS kind, param_ga_session_id AS sid, {revenue} AS revenue FROM {table} {extra} WHERE {where}")
    return fixture_sql(f"""
SELECT spine.tenant_id, spine.date_group, strftime(period, '%Y-%m-%d %H:%M:%S') AS period_start,
       COALESCE(round(SUM(revenue), 2), 0)::DOUBLE AS revenue,
       COUNT(*) FILTER (kind = 'purchase') AS purchases,
       COUNT(DISTINCT sid) FILTER (kind = 'view') AS visitors,
       COUNT(DISTINCT sid) FILTER (kind = 'cart') AS carts,
       COUNT(*) FILTER (kind = 'search') AS searches
FROM spine LEFT JOIN counted USING (tenant_id, date_group) GROUP BY ALL
""", extra_ctes=f"""
counted AS (
  {rows('purchase', 'purchase', 'ecommerce_purchase_revenue')}
  UNION ALL {rows('view', 'page_view')}
  UNION ALL {rows('cart', 'add_to_cart', extra='ANTI JOIN purchase USING (tenant_id, param_ga_session_id)')}
  UNION ALL {rows('search', 'view_search_results')}
  UNION ALL {rows('search', 'no_search_results')}),
spine AS (
  SELECT DISTINCT tenant_id, {point_label} AS date_group, {point} AS period
  FROM (SELECT tenant_id FROM base UNION SELECT tenant_id FROM users UNION SELECT tenant_id FROM locations) who,
       (SELECT unnest(generate_series(TIMESTAMP '{start} 00:00:00', TIMESTAMP '{end} 23:59:59', INTERVAL {step})) AS moment) points)
""")


def _q2(g):
    def fn(spark, sf_dir):
        from sessionscope.plans.chart import chart_data
        return chart_data(tables(spark, sf_dir), START, END, g)
    return fn


for _g in ("daily", "hourly", "4hours", "12hours", "weekly", "monthly"):
    register(f"q2_chart_data_{_g}", q2_sql(_g))(_q2(_g))


# ---------------------------------------------------------------- Q3
Q3_SQL = fixture_sql(f"""
SELECT l.tenant_id, l.warehouse_code AS location_id, l.warehouse_name AS location_name, l.city, l.state,
       COALESCE('$' || SUM(v) FILTER (what = 'revenue')::VARCHAR, '$0') AS total_revenue,
       COUNT(*) FILTER (what = 'revenue') AS purchases,
       COALESCE(SUM(v) FILTER (what = 'visits'), 0)::BIGINT AS total_visitors,
       COUNT(sid) FILTER (what = 'cart') AS abandoned_carts,
       COUNT(*) FILTER (what = 'visits' AND known AND v > 1) AS repeat_visits,
       COUNT(*) FILTER (what = 'failed') AS failed_searches
FROM (SELECT * FROM locations WHERE is_active) l LEFT JOIN facts f ON f.tenant_id = l.tenant_id AND f.branch = l.warehouse_code
GROUP BY ALL
""", extra_ctes=f"""
facts(tenant_id, branch, what, v, sid, known) AS (
  SELECT tenant_id, user_prop_default_branch_id, 'revenue', ecommerce_purchase_revenue::DECIMAL(38,2), NULL, NULL FROM purchase WHERE {_in_range()}
  UNION ALL SELECT tenant_id, user_prop_default_branch_id, 'visits', COUNT(DISTINCT param_ga_session_id), NULL, user_prop_webuserid IS NOT NULL
    FROM page_view WHERE {_in_range()} GROUP BY tenant_id, user_prop_default_branch_id, user_prop_webuserid
  UNION ALL SELECT DISTINCT tenant_id, user_prop_default_branch_id, 'cart', NULL::DECIMAL(38,2), param_ga_session_id, NULL::BOOLEAN
    FROM add_to_cart ANTI JOIN purchase USING (tenant_id, param_ga_session_id) WHERE {_in_range()}
  UNION ALL SELECT tenant_id, user_prop_default_branch_id, 'failed', NULL, NULL, NULL FROM no_search_results WHERE {_in_range()})
""")


@register("q3_location_stats", Q3_SQL)
def q3_location_stats(spark, sf_dir):
    from sessionscope.plans.locations import location_stats
    return location_stats(tables(spark, sf_dir), START, END)


# ---------------------------------------------------------------- Q13 / Q14
@register("q13_locations_list", fixture_sql("""
SELECT tenant_id, warehouse_code AS location_id, warehouse_name AS location_name, city, state
FROM locations WHERE is_active = true ORDER BY tenant_id, warehouse_name"""))
def q13_locations_list(spark, sf_dir):
    from sessionscope.plans.locations import locations_list
    return locations_list(tables(spark, sf_dir))


@register("q14_data_availability", fixture_sql("""
SELECT tenant_id, CAST(SUM(cnt) AS BIGINT) AS event_count,
       strftime(MIN(min_date), '%Y-%m-%d') AS earliest_date, strftime(MAX(max_date), '%Y-%m-%d') AS latest_date
FROM (
  SELECT tenant_id, COUNT(*) AS cnt, MIN(event_date) AS min_date, MAX(event_date) AS max_date FROM purchase GROUP BY 1
  UNION ALL SELECT tenant_id, COUNT(*), MIN(event_date), MAX(event_date) FROM add_to_cart GROUP BY 1
  UNION ALL SELECT tenant_id, COUNT(*), MIN(event_date), MAX(event_date) FROM page_view GROUP BY 1
  UNION ALL SELECT tenant_id, COUNT(*), MIN(event_date), MAX(event_date) FROM view_search_results GROUP BY 1
  UNION ALL SELECT tenant_id, COUNT(*), MIN(event_date), MAX(event_date) FROM no_search_results GROUP BY 1
  UNION ALL SELECT tenant_id, COUNT(*), MIN(event_date), MAX(event_date) FROM view_item GROUP BY 1
) table_stats GROUP BY tenant_id"""))
def q14_data_availability(spark, sf_dir):
    from sessionscope.plans.availability import data_availability
    return data_availability(tables(spark, sf_dir))


# ---------------------------------------------------------------- Q4-Q10 worklists
def _customer(alias: str) -> str:
    """The customer of a row: by user id, and only where that is missing by the company's ERP id (fixture CTE ``contacts``)."""
    return (f"LEFT JOIN contacts u ON u.tenant_id = {alias}.tenant_id AND u.contact = "
            f"COALESCE('id ' || {alias}.user_prop_webuserid, 'erp ' || {alias}.user_prop_webcustomerid)")


_UCOLS = "u.user_id, u.buying_company_name AS customer_name, u.email, u.cell_phone AS phone, u.office_phone"
_DAY = "strftime(make_timestamp(CAST({c} AS BIGINT)), '%Y-%m-%d')"
_NO_PURCHASE = ("NOT EXISTS (SELECT 1 FROM purchase p WHERE p.param_ga_session_id = {a}.param_ga_session_id "
                "AND p.tenant_id = {a}.tenant_id)")


def q4_sql(page: int | None = None, limit: int | None = None) -> str:
    order = "fp.event_timestamp DESC NULLS FIRST, fp.event_id ASC NULLS FIRST, u.user_id ASC NULLS FIRST"
    rn = f", row_number() OVER (PARTITION BY fp.tenant_id ORDER BY {order}) AS row_num" if limit else ""
    body = f"""
SELECT fp.tenant_id, fp.param_transaction_id AS transaction_id, {_DAY.format(c='fp.event_timestamp')} AS event_date,
       CAST(round(COALESCE(fp.ecommerce_purchase_revenue, 0), 2) AS DOUBLE) AS order_value,
       COALESCE(fp.param_page_location, '') AS page_location, fp.param_ga_session_id AS ga_session_id,
       {_UCOLS}, COALESCE(fp.items_json, '[]') AS products, false AS completed,
       COUNT(*) OVER (PARTITION BY fp.tenant_id) AS total_count {rn}
FROM purchase fp {_customer('fp')}"""
    if limit:
        first = (page - 1) * limit
        body = f"SELECT * FROM ({body}) x WHERE row_num > {first} AND row_num <= {first + limit}"
    return fixture_sql(body)


@register("q4_purchase_tasks", q4_sql())
def q4_purchase_tasks(spark, sf_dir):
    from sessionscope.plans.worklists import purchase_tasks
    return purchase_tasks(tables(spark, sf_dir))


_CART_ITEM = ("concat_ws('|', COALESCE(first_item_item_id, ''), COALESCE(first_item_item_name, ''), COALESCE(first_item_item_category, ''), "
              "COALESCE(first_item_price::VARCHAR, ''), COALESCE(first_item_quantity::VARCHAR, ''))")


def q5_sql(qualifying: str = "add_to_cart") -> str:
    """Open sessions are a set difference; a session's items are the histogram of their texts."""
    return fixture_sql(f"""
SELECT c.tenant_id, sid AS session_id, {_DAY.format(c='last_at')} AS event_date, {_DAY.format(c='last_at')} AS last_activity,
       items_count, round(total_value, 2)::DOUBLE AS total_value, {_UCOLS},
       array_to_string(list_sort(list_transform(map_entries(items), lambda e: e.key || 'x' || e.value)), ';') AS products,
       COUNT(*) OVER (PARTITION BY c.tenant_id) AS total_count
FROM carts c {_customer('c')}
""", extra_ctes=f"""
open_sessions AS (SELECT tenant_id, param_ga_session_id FROM {qualifying} WHERE param_ga_session_id IS NOT NULL
                  EXCEPT SELECT tenant_id, param_ga_session_id FROM purchase),
carts AS (SELECT tenant_id, param_ga_session_id AS sid, user_prop_webuserid, MAX(user_prop_webcustomerid) AS user_prop_webcustomerid,
                 MAX(event_timestamp) AS last_at, COUNT(event_id) AS items_count, SUM(first_item_price * first_item_quantity) AS total_value,
                 histogram({_CART_ITEM}) AS items
          FROM add_to_cart SEMI JOIN open_sessions USING (tenant_id, param_ga_session_id) GROUP BY ALL)
""")


Q5_SQL = q5_sql()


@register("q5_cart_abandonment_tasks", Q5_SQL)
def q5_cart_abandonment_tasks(spark, sf_dir):
    from sessionscope.plans.worklists import cart_abandonment_tasks
    return cart_abandonment_tasks(tables(spark, sf_dir))


def _search_ctes(failed: str = "true", found: str = "true", join: str = "ANTI JOIN purchase USING (tenant_id, param_ga_session_id)") -> str:
    """Search tasks of both kinds in one grouping: a failed search is keyed by its term, a successful one by its session alone."""
    return f"""
search_rows AS (
  SELECT tenant_id, param_ga_session_id, user_prop_webuserid, user_prop_webcustomerid, event_timestamp,
         'no_results' AS search_type, param_no_search_results_term AS term, param_no_search_results_term AS key_term
  FROM no_search_results WHERE {failed.format(c='param_no_search_results_term')}
  UNION ALL
  SELECT tenant_id, param_ga_session_id, user_prop_webuserid, user_prop_webcustomerid, event_timestamp, 'no_conversion', param_search_term, NULL
  FROM view_search_results {join} WHERE {found.format(c='param_search_term')}),
search_tasks AS (
  SELECT tenant_id, param_ga_session_id, user_prop_webuserid, search_type, MAX(user_prop_webcustomerid) AS user_prop_webcustomerid,
         nullif(array_to_string(list_sort(list(DISTINCT term)), ', '), '') AS terms, key_term, COUNT(*) AS search_count, MAX(event_timestamp) AS last_at
  FROM search_rows GROUP BY tenant_id, param_ga_session_id, user_prop_webuserid, search_type, key_term
  HAVING search_type = 'no_results' OR COUNT(*) > 2)
"""


def q6_sql(**kw) -> str:
    return fixture_sql(f"""
SELECT s.tenant_id, s.param_ga_session_id AS session_id, {_DAY.format(c='s.last_at')} AS event_date,
       CASE search_type WHEN 'no_results' THEN key_term ELSE terms END AS search_term, search_type, search_count, {_UCOLS},
       COUNT(*) OVER (PARTITION BY s.tenant_id) AS total_count
FROM search_tasks s {_customer('s')}""", extra_ctes=_search_ctes(**kw))


Q6_SQL = q6_sql()


@register("q6_search_analysis_tasks", Q6_SQL)
def q6_search_analysis_tasks(spark, sf_dir):
    from sessionscope.plans.worklists import search_analysis_tasks
    return search_analysis_tasks(tables(spark, sf_dir))


@register("q6_search_facets", fixture_sql("""
SELECT tenant_id, search_type AS value,
       CASE search_type WHEN 'no_results' THEN 'No Results' WHEN 'no_conversion' THEN 'No Conversion' ELSE search_type END AS label,
       COUNT(*) AS count
FROM search_tasks GROUP BY tenant_id, search_type""", extra_ctes=_search_ctes()))
def q6_search_facets(spark, sf_dir):
    from sessionscope.plans.worklists import search_facets
    return search_facets(tables(spark, sf_dir))


def q7_sql(limit: int | None = None) -> str:
    """Long sessions are counted over their user by a window; products come from one grouping of the item views."""
    order = ("page_views_count DESC NULLS LAST, last_at DESC NULLS FIRST, v.sid ASC NULLS FIRST, "
             "v.user_prop_webuserid ASC NULLS FIRST, u.user_id ASC NULLS FIRST")
    place = f", row_number() OVER (PARTITION BY v.tenant_id ORDER BY {order}) AS row_num" if limit else ""
    body = f"""
SELECT v.tenant_id, v.sid AS session_id, {_DAY.format(c='v.last_at')} AS event_date, page_views_count,
       COALESCE(products_viewed, 0)::BIGINT AS products_viewed, COALESCE(products_details, '') AS products_details, {_UCOLS},
       COUNT(*) OVER (PARTITION BY v.tenant_id) AS total_count {place}
FROM loyal v {_customer('v')} LEFT JOIN viewed w ON w.tenant_id = v.tenant_id AND w.sid = v.sid"""
    return fixture_sql(f"SELECT * FROM ({body}) x WHERE row_num <= {limit}" if limit else body, extra_ctes="""
loyal AS (
  SELECT * FROM (
    SELECT tenant_id, param_ga_session_id AS sid, user_prop_webuserid, MAX(user_prop_webcustomerid) AS user_prop_webcustomerid,
           COUNT(DISTINCT param_page_location) AS page_views_count, MAX(event_timestamp) AS last_at
    FROM page_view WHERE user_prop_webuserid IS NOT NULL GROUP BY ALL)
  WHERE page_views_count > 2 QUALIFY COUNT(sid) OVER (PARTITION BY tenant_id, user_prop_webuserid) > 1),
viewed AS (
  SELECT tenant_id, param_ga_session_id AS sid, COUNT(DISTINCT first_item_item_id) AS products_viewed,
         array_to_string(list_sort(list(DISTINCT concat_ws('|', COALESCE(first_item_item_name, first_item_item_id), COALESCE(param_page_location, ''),
           COALESCE(first_item_item_category, ''), COALESCE(first_item_price::VARCHAR, '')) || 'x1')), ';') AS products_details
  FROM view_item WHERE first_item_item_id IS NOT NULL AND param_ga_session_id IS NOT NULL GROUP BY ALL)
""")


Q7_SQL = q7_sql()


@register("q7_repeat_visit_tasks", Q7_SQL)
def q7_repeat_visit_tasks(spark, sf_dir):
    from sessionscope.plans.worklists import repeat_visit_tasks
    return repeat_visit_tasks(tables(spark, sf_dir))


# A session bounces when all its pages are one page; its entry page is the first of its ordered list.
_ONE_PAGE = """
one_page AS (
  SELECT tenant_id, param_ga_session_id AS sid, user_prop_webuserid, MAX(user_prop_webcustomerid) AS user_prop_webcustomerid,
         MAX(event_timestamp) AS last_at, list(param_page_location ORDER BY event_timestamp, event_id)[1] AS entry_page
  FROM page_view GROUP BY ALL HAVING MIN(param_page_location) = MAX(param_page_location))
"""
_PER_PAGE = "SELECT tenant_id, entry_page, COUNT(*) AS n FROM one_page GROUP BY ALL"


@register("q8_performance_bounced_sessions", fixture_sql(f"""
SELECT b.tenant_id, b.sid AS session_id, {_DAY.format(c='b.last_at')} AS event_date, b.entry_page, {_UCOLS}, b.total_count
FROM (SELECT *, COUNT(*) OVER (PARTITION BY tenant_id) AS total_count FROM one_page) b {_customer('b')}""", extra_ctes=_ONE_PAGE))
def q8_performance_bounced_sessions(spark, sf_dir):
    from sessionscope.plans.worklists import performance_bounced_sessions
    return performance_bounced_sessions(tables(spark, sf_dir))


@register("q9_performance_bounced_pages", fixture_sql(f"""
SELECT tenant_id, entry_page, n AS bounce_count, row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, entry_page NULLS FIRST) AS rank
FROM ({_PER_PAGE}) QUALIFY rank <= 10""", extra_ctes=_ONE_PAGE))
def q9_performance_bounced_pages(spark, sf_dir):
    from sessionscope.plans.worklists import frequently_bounced_pages
    return frequently_bounced_pages(tables(spark, sf_dir))


@register("q10_performance_facets", fixture_sql(f"""
SELECT tenant_id, value, label, count, row_number() OVER (PARTITION BY tenant_id ORDER BY count::VARCHAR DESC, value) AS position
FROM (SELECT tenant_id, unnest([{{'value': 'high_bounce', 'label': 'High Bounce', 'count': SUM(n)::BIGINT}},
                                {{'value': 'page_bounce_issue', 'label': 'Page Bounce', 'count': least(COUNT(*), 10)}}], recursive := true)
      FROM ({_PER_PAGE}) GROUP BY tenant_id)""", extra_ctes=_ONE_PAGE))
def q10_performance_facets(spark, sf_dir):
    from sessionscope.plans.worklists import performance_facets
    return performance_facets(tables(spark, sf_dir))


# ---------------------------------------------------------------- U1 / Q11 / Q12 timelines
def _timeline_cte() -> str:
    """Every source event once for each kind that it counts as, straight from the fixture's base rows. What a kind shows is a list of
    (name, value) pairs; one expression turns any such list into JSON text."""
    shown = {
        "purchase": {"transaction_id": "'TX' || event_id", "revenue": "value::DECIMAL(15,2) * 5", "items": "items_json"},
        "add_to_cart": {"item_id": "'P' || k", "item_name": "'Item ' || k % 10", "price": "value::DECIMAL(10,2)", "quantity": "k % 5 + 1"},
        "view_item": {"item_id": "'P' || k", "item_name": "'Item ' || k % 10", "price": "value::DECIMAL(10,2)", "category": "'Cat ' || k % 5"},
        "page_view": {"page_location": "param_page_location", "page_title": "param_page_title"},
        "view_search_results": {"search_term": "'term ' || k % 15"},
    }
    shown["no_search_results"] = shown["view_search_results"]
    numbers = ("revenue", "price", "quantity")

    def entry(name: str, value: str) -> str:
        number = f"({value})::DECIMAL(15,2)::VARCHAR" if name == "revenue" else f"({value})::VARCHAR"
        return f"""'"{name}":' || COALESCE({number if name in numbers else f"to_json({value})::VARCHAR"}, 'null')"""

    texts = "\n".join(f"      WHEN '{kind}' THEN [{', '.join(entry(n, v) for n, v in pairs.items())}]" for kind, pairs in shown.items())
    return f"""
kinds AS (
  SELECT *, unnest(CASE event_type WHEN 'view' THEN ['page_view'] WHEN 'signup' THEN ['page_view', 'view_item'] WHEN 'click' THEN ['add_to_cart']
                   WHEN 'error' THEN [CASE WHEN k % 3 = 0 THEN 'no_search_results' ELSE 'view_search_results' END] WHEN 'purchase' THEN ['purchase'] END) AS kind
  FROM base),
timeline AS (
  SELECT tenant_id, event_timestamp AS moment, param_ga_session_id AS sid, kind, '{{' || array_to_string(CASE kind
{texts}
    END, ',') || '}}' AS shown
  FROM kinds),
watchers AS (
  SELECT tenant_id, param_ga_session_id AS sid, list(DISTINCT user_prop_webuserid) AS seen_by
  FROM base WHERE event_type IN ('view', 'signup') AND user_prop_webuserid IS NOT NULL GROUP BY ALL)"""


_TIMELINE = _timeline_cte()
#: Every user's timeline: the events of the sessions in which that user viewed a page.
_WATCHED = "SELECT tenant_id, unnest(seen_by) AS user_id, moment, sid, kind, shown FROM timeline JOIN watchers USING (tenant_id, sid)"


@register("u1_union_all_events", fixture_sql(
    "SELECT tenant_id, moment AS event_timestamp, sid AS param_ga_session_id, kind AS event_type, shown AS details FROM timeline",
    extra_ctes=_TIMELINE))
def u1_union_all_events(spark, sf_dir):
    from sessionscope.plans.history import all_events
    return all_events(tables(spark, sf_dir))


@register("q11_user_history", fixture_sql(
    f"SELECT tenant_id, user_id, moment AS event_timestamp, sid AS session_id, kind AS event_type, shown AS details FROM ({_WATCHED}) w",
    extra_ctes=_TIMELINE))
def q11_user_history(spark, sf_dir):
    from sessionscope.plans.history import user_history
    return user_history(tables(spark, sf_dir))


@register("q12_session_history", fixture_sql(
    "SELECT tenant_id, sid AS session_id, moment AS event_timestamp, kind AS event_type, shown AS details FROM timeline WHERE sid IS NOT NULL", extra_ctes=_TIMELINE))
def q12_session_history(spark, sf_dir):
    from sessionscope.plans.history import session_history
    return session_history(tables(spark, sf_dir))


# ---------------------------------------------------------------- Q15-Q20 operational histories
AS_OF_JOBS = "2001-11-05 00:00:00"
_TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _page_sql(inner: str, order: str, limit: int, offset: int) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY {order}) AS row_num "
            f"FROM ({inner}) i) x WHERE row_num > {offset} AND row_num <= {offset + limit}")


@register("q15_ingestion_jobs_page", fixture_sql(_page_sql(f"""
SELECT id, tenant_id, job_id, status, data_types, strftime(start_date, '%Y-%m-%d') AS start_date,
       strftime(end_date, '%Y-%m-%d') AS end_date, progress, records_processed, error_message,
       {_TS.format(c='created_at')} AS created_at, {_TS.format(c='started_at')} AS started_at,
       {_TS.format(c='completed_at')} AS completed_at, COUNT(*) OVER (PARTITION BY tenant_id) AS total_count
FROM processing_jobs""", "created_at DESC, job_id ASC", 50, 100)))
def q15_ingestion_jobs_page(spark, sf_dir):
    from sessionscope.plans.jobs import ingestion_jobs_page
    return ingestion_jobs_page(tables(spark, sf_dir), limit=50, offset=100)


@register("q16_email_jobs_page", fixture_sql(_page_sql(f"""
SELECT tenant_id, job_id, status, strftime(report_date, '%Y-%m-%d') AS report_date,
       array_to_string(target_branches, ',') AS target_branches, total_emails, emails_sent, emails_failed,
       error_message, {_TS.format(c='created_at')} AS created_at, {_TS.format(c='started_at')} AS started_at,
       {_TS.format(c='completed_at')} AS completed_at, COUNT(*) OVER (PARTITION BY tenant_id) AS total_count,
       (50 < COUNT(*) OVER (PARTITION BY tenant_id)) AS has_more
FROM email_sending_jobs WHERE status = 'completed'""", "created_at DESC, job_id ASC", 50, 0)))
def q16_email_jobs_page(spark, sf_dir):
    from sessionscope.plans.jobs import email_jobs_page
    return email_jobs_page(tables(spark, sf_dir), limit=50, offset=0, status="completed")


@register("q17_email_history_page", fixture_sql(_page_sql(f"""
SELECT tenant_id, id, job_id, branch_code, sales_rep_email, sales_rep_name, subject,
       strftime(report_date, '%Y-%m-%d') AS report_date, status, smtp_response, error_message,
       {_TS.format(c='sent_at')} AS sent_at, COUNT(*) OVER (PARTITION BY tenant_id) AS total_count
FROM email_send_history""", "sent_at DESC, id ASC", 50, 0)))
def q17_email_history_page(spark, sf_dir):
    from sessionscope.plans.jobs import email_history_page
    return email_history_page(tables(spark, sf_dir), limit=50, offset=0)


@register("q19_stuck_jobs", fixture_sql(f"""
SELECT 'ingestion' AS job_type, tenant_id, job_id, status,
       COALESCE(CAST(json_extract_string(progress, '$.retrigger_count') AS INTEGER), 0) AS retrigger_count,
       CASE WHEN status = 'queued' AND COALESCE(CAST(json_extract_string(progress, '$.retrigger_count') AS INTEGER), 0) < 3
            THEN 'retrigger' ELSE 'fail' END AS action,
       CASE WHEN status = 'queued' AND COALESCE(CAST(json_extract_string(progress, '$.retrigger_count') AS INTEGER), 0) < 3 THEN NULL
            WHEN status = 'queued' THEN 'Job failed after 3 re-trigger attempts — worker never picked it up successfully'
            ELSE 'Worker was killed (OOM or crash) while processing ''' || COALESCE(json_extract_string(progress, '$.current'), 'unknown step')
                 || ''' after 15 minutes' END AS error_message
FROM processing_jobs
WHERE status IN ('processing', 'queued') AND updated_at < TIMESTAMP '{AS_OF_JOBS}' - INTERVAL 15 MINUTE
UNION ALL
SELECT 'email', tenant_id, job_id, status, CAST(NULL AS INTEGER), 'fail',
       CASE WHEN status = 'queued' THEN 'Email job was never picked up by worker after 15 minutes'
            ELSE 'Email worker was killed (OOM or crash) after 15 minutes' END
FROM email_sending_jobs
WHERE status IN ('processing', 'queued') AND updated_at < TIMESTAMP '{AS_OF_JOBS}' - INTERVAL 15 MINUTE"""))
def q19_stuck_jobs(spark, sf_dir):
    from sessionscope.plans.jobs import stuck_jobs
    return stuck_jobs(tables(spark, sf_dir), AS_OF_JOBS)


@register("q20_branch_mappings_list", fixture_sql("""
SELECT tenant_id, branch_code, branch_name, sales_rep_email, sales_rep_name, is_enabled
FROM branch_email_mappings ORDER BY tenant_id, branch_code, sales_rep_email"""))
def q20_branch_mappings_list(spark, sf_dir):
    from sessionscope.plans.jobs import branch_mappings_list
    return branch_mappings_list(tables(spark, sf_dir))


@register("r10_email_job_rollup", fixture_sql("""
SELECT tenant_id, job_id, COUNT(*) AS total,
       CAST(SUM(CASE WHEN status = 'sent' THEN 1 ELSE 0 END) AS BIGINT) AS sent,
       CAST(SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
       CASE WHEN SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > 0 AND SUM(CASE WHEN status = 'sent' THEN 1 ELSE 0 END) > 0
            THEN 'completed_with_errors'
            WHEN SUM(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) > 0 THEN 'failed' ELSE 'completed' END AS status
FROM email_send_history GROUP BY tenant_id, job_id"""))
def r10_email_job_rollup(spark, sf_dir):
    from sessionscope.plans.jobs import email_job_rollup
    return email_job_rollup(tables(spark, sf_dir))


@register("a15_map_values_sum", fixture_sql("""
SELECT tenant_id, job_id,
       CAST(COALESCE(CAST(json_extract_string(records_processed, '$.purchase') AS BIGINT), 0)
            + COALESCE(CAST(json_extract_string(records_processed, '$.page_view') AS BIGINT), 0) AS BIGINT) AS total_records,
       CASE WHEN completed_at IS NULL THEN '—'
            WHEN epoch(completed_at - started_at) < 0 THEN '—'
            WHEN epoch(completed_at - started_at) < 60 THEN
                 CASE WHEN round(epoch(completed_at - started_at), 1) = floor(round(epoch(completed_at - started_at), 1))
                      THEN CAST(CAST(floor(round(epoch(completed_at - started_at), 1)) AS BIGINT) AS VARCHAR)
                      ELSE printf('%.1f', round(epoch(completed_at - started_at), 1)) END || 's'
            WHEN floor(epoch(completed_at - started_at) / 3600) > 0 THEN
                 CASE WHEN floor((CAST(floor(epoch(completed_at - started_at)) AS BIGINT) % 3600) / 60) > 0
                      THEN CAST(CAST(floor(epoch(completed_at - started_at) / 3600) AS BIGINT) AS VARCHAR) || 'h '
                           || CAST(CAST(floor((CAST(floor(epoch(completed_at - started_at)) AS BIGINT) % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm'
                      ELSE CAST(CAST(floor(epoch(completed_at - started_at) / 3600) AS BIGINT) AS VARCHAR) || 'h' END
            ELSE CAST(CAST(floor((CAST(floor(epoch(completed_at - started_at)) AS BIGINT) % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm'
       END AS duration
FROM processing_jobs"""))
def a15_map_values_sum(spark, sf_dir):
    from sessionscope.plans.jobs import records_processed_total
    return records_processed_total(tables(spark, sf_dir))


# ---------------------------------------------------------------- I1-I17 ingest
def raw_sources(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.fixtures import base_events, read_source
    from sessionscope.sources import raw
    t = tables(spark, sf_dir)
    return t, raw.raw_events(t.base), raw.raw_customer_master(read_source(spark, sf_dir, "customer")).withColumn(
        "tenant_id", F.concat(F.lit("T"), F.col("_tenant_bit").cast("string"))), \
        raw.raw_locations_file(read_source(spark, sf_dir, "nation"), read_source(spark, sf_dir, "region"))


_COMMON_OUT = ("tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_timestamp, user_pseudo_id, "
               "user_prop_webuserid, user_prop_default_branch_id, user_prop_webcustomerid, param_ga_session_id, "
               "param_page_title, param_page_location, device_category, device_operating_system, geo_country, geo_city")
_COMMON_COLS = ["tenant_id", "event_date", "event_timestamp", "user_pseudo_id", "user_prop_webuserid",
                "user_prop_default_branch_id", "user_prop_webcustomerid", "param_ga_session_id", "param_page_title",
                "param_page_location", "device_category", "device_operating_system", "geo_country", "geo_city"]
_EXTRA_OUT = {
    "purchase": "param_transaction_id, CAST(round(ecommerce_purchase_revenue, 2) AS DOUBLE) AS ecommerce_purchase_revenue, 1 AS items_count",
    "add_to_cart": "first_item_item_id, first_item_item_name, first_item_item_category, "
                   "CAST(round(first_item_price, 2) AS DOUBLE) AS first_item_price, first_item_quantity, 1 AS items_count",
    "page_view": "param_page_referrer",
    "view_search_results": "param_search_term",
    "no_search_results": "param_no_search_results_term",
    "view_item": "first_item_item_id, first_item_item_name, first_item_item_category, "
                 "CAST(round(first_item_price, 2) AS DOUBLE) AS first_item_price, 1 AS items_count",
}
# Before reclassification the failed-search tag covers k % 3 in (0, 1) (FIXTURES §2).
_PRE_RECLASS = {
    "view_search_results": "SELECT *, 'term ' || CAST(k % 15 AS VARCHAR) AS param_search_term FROM base "
                           "WHERE event_type = 'error' AND k % 3 = 2",
    "no_search_results": "SELECT *, 'term ' || CAST(k % 15 AS VARCHAR) AS param_no_search_results_term FROM base "
                         "WHERE event_type = 'error' AND k % 3 IN (0, 1)",
}


def _extract_out(df, table):
    from pyspark.sql import functions as F
    from sessionscope.functions.text import money
    cols = [F.date_format("event_date", "yyyy-MM-dd").alias("event_date") if c == "event_date" else F.col(c)
            for c in _COMMON_COLS]
    extra = {
        "purchase": [F.col("param_transaction_id"), money(F.col("ecommerce_purchase_revenue"))
                     .alias("ecommerce_purchase_revenue")],
        "add_to_cart": [F.col("first_item_item_id"), F.col("first_item_item_name"), F.col("first_item_item_category"),
                        money(F.col("first_item_price")).alias("first_item_price"), F.col("first_item_quantity")],
        "view_item": [F.col("first_item_item_id"), F.col("first_item_item_name"), F.col("first_item_item_category"),
                      money(F.col("first_item_price")).alias("first_item_price")],
        "page_view": [F.col("param_page_referrer")],
        "view_search_results": [F.col("param_search_term")],
        "no_search_results": [F.col("param_no_search_results_term")],
    }[table]
    if table in ("purchase", "add_to_cart", "view_item"):
        extra.append(F.size(F.from_json("items_json", "array<struct<item_id:string>>")).alias("items_count"))
    return df.select(*cols, *extra)


@register("i1_raw_event_range_scan", fixture_sql(f"""
SELECT tenant_id, strftime(event_date, '%Y%m%d') AS event_date, CAST(event_timestamp AS BIGINT) AS event_timestamp,
       'purchase' AS event_name, user_pseudo_id
FROM purchase WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}'"""))
def i1_raw_event_range_scan(spark, sf_dir):
    from sessionscope.sources.extract import scan_range
    return scan_range(raw_export(spark, sf_dir), START, END, ["purchase"]).select(
        "tenant_id", "event_date", "event_timestamp", "event_name", "user_pseudo_id")


def raw_export(spark, sf_dir):
    """The raw export as landed files, partitioned by day; written once beside the warehouse."""
    from sessionscope.session import path_exists, rename_path
    from sessionscope.sources.extract import read_raw_export, write_raw_export
    t, raw, _, _ = raw_sources(spark, sf_dir)
    path = t.extra["warehouse"] + "/raw_export"
    if not path_exists(spark, path):
        private = f"{path}.building-{spark.sparkContext.applicationId}"
        write_raw_export(raw, private)
        rename_path(spark, private, path)
    return read_raw_export(spark, path, raw.schema)


def _extract_query(table):
    def fn(spark, sf_dir):
        from sessionscope.sources.extract import extract_table
        _, raw, _, _ = raw_sources(spark, sf_dir)
        return _extract_out(extract_table(raw, table, START, END), table)
    src = f"({_PRE_RECLASS[table]})" if table in _PRE_RECLASS else table
    sql = fixture_sql(f"SELECT {_COMMON_OUT}, {_EXTRA_OUT[table]} FROM {src} x "
                      f"WHERE event_date BETWEEN DATE '{START}' AND DATE '{END}'")
    return fn, sql


for _i, _t in enumerate(("purchase", "add_to_cart", "page_view", "view_search_results", "no_search_results",
                         "view_item"), start=2):
    _fn, _sql = _extract_query(_t)
    register(f"i{_i}_extract_{_t}", _sql)(_fn)


_I8_EXTRAS = ["param_transaction_id", "ecommerce_purchase_revenue", "items_json", "first_item_item_id", "first_item_item_name",
              "first_item_item_category", "first_item_price", "first_item_quantity", "param_page_referrer", "param_search_term",
              "param_no_search_results_term"]


def _i8_sql() -> str:
    """All six types by their raw event names (before I13), each with its own columns; items are compared by the first one."""
    common = """tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_timestamp, user_pseudo_id, user_prop_webuserid,
       user_prop_default_branch_id, user_prop_webcustomerid, param_ga_session_id, param_page_title, param_page_location,
       device_category, device_operating_system, geo_country, geo_city"""
    own = {"purchase": ["param_transaction_id", "ecommerce_purchase_revenue"], "add_to_cart": _I8_EXTRAS[3:8], "page_view": ["param_page_referrer"],
           "view_item": _I8_EXTRAS[3:7], "view_search_results": ["param_search_term"], "no_search_results": ["param_no_search_results_term"]}
    money = ("ecommerce_purchase_revenue", "first_item_price")

    def part(table, source, columns, where=""):
        extras = [f"CAST({columns.get(c, 'NULL')} AS {'DOUBLE' if c in money else 'INTEGER' if c == 'first_item_quantity' else 'VARCHAR'}) AS {c}"
                  for c in _I8_EXTRAS if c != "items_json"]
        return f"SELECT '{table}' AS event_table, {common}, {', '.join(extras)} FROM {source} {where}"

    parts = [part(t, t, {c: c for c in cols}) for t, cols in own.items() if "search" not in t]
    parts.append(part("view_search_results", "view_search_results", {"param_search_term": "param_search_term"}, "WHERE k % 3 = 2"))
    parts.append(part("no_search_results", "view_search_results", {"param_no_search_results_term": "param_search_term"}, "WHERE k % 3 <> 2"))
    parts.append(part("no_search_results", "no_search_results", {"param_no_search_results_term": "param_no_search_results_term"}))
    return "\nUNION ALL ".join(parts)


@register("i8_extract_all_event_types", fixture_sql(_i8_sql()))
def i8_extract_all_event_types(spark, sf_dir):
    """Every row of the six types out of one pass over the export, with the columns of its table."""
    from pyspark.sql import functions as F
    from sessionscope.sources.extract import extract_events
    _, raw, _, _ = raw_sources(spark, sf_dir)
    rows = extract_events(raw, None, None).drop("event_id", "raw_data", "items_json")
    return rows.withColumns({"event_date": F.date_format("event_date", "yyyy-MM-dd"), **{c: F.col(c).cast("double") for c in ("ecommerce_purchase_revenue", "first_item_price")}})


@register("i13_reclassify_search_events", fixture_sql("""
SELECT 'view_search_results' AS event_table, tenant_id, event_timestamp, param_ga_session_id, param_page_title,
       param_search_term AS term FROM view_search_results
UNION ALL
SELECT 'no_search_results', tenant_id, event_timestamp, param_ga_session_id, param_page_title,
       param_no_search_results_term FROM no_search_results"""))
def i13_reclassify_search_events(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.extract import extract_all, reclassify_search_events
    _, raw, _, _ = raw_sources(spark, sf_dir)
    r = reclassify_search_events(extract_all(raw, None, None))
    cols = ["tenant_id", "event_timestamp", "param_ga_session_id", "param_page_title"]
    return (r["view_search_results"].select(F.lit("view_search_results").alias("event_table"), *cols,
                                            F.col("param_search_term").alias("term"))
            .unionByName(r["no_search_results"].select(F.lit("no_search_results").alias("event_table"), *cols,
                                                       F.col("param_no_search_results_term").alias("term"))))


@register("i9_extract_users", fixture_sql(
    "SELECT tenant_id, user_id, user_name, buying_company_name, buying_company_erp_id, email, office_phone, cell_phone FROM users"))
def i9_extract_users(spark, sf_dir):
    from sessionscope.sources.masters import extract_users
    _, _, master, _ = raw_sources(spark, sf_dir)
    return extract_users(master)


@register("i10_normalize_locations", """
SELECT CAST(n_nationkey AS VARCHAR) AS warehouse_id, 'D' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS warehouse_code,
       n_name AS warehouse_name, 'City ' || CAST(n_nationkey AS VARCHAR) AS city, r_name AS state,
       CAST(10000 + n_nationkey * 7 AS VARCHAR) AS zip
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 NOT IN (1, 2)""")
def i10_normalize_locations(spark, sf_dir):
    from sessionscope.sources.masters import normalize_locations
    _, _, _, locfile = raw_sources(spark, sf_dir)
    return normalize_locations(locfile)


@register("i11_parse_event_date", fixture_sql("""
SELECT DISTINCT strftime(event_date, '%Y%m%d') AS raw_date, strftime(event_date, '%Y-%m-%d') AS event_date FROM base"""))
def i11_parse_event_date(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.extract import parse_event_date
    _, raw, _, _ = raw_sources(spark, sf_dir)
    return raw.select(F.col("event_date").alias("raw_date")).distinct().select(
        "raw_date", F.date_format(parse_event_date(F.col("raw_date")), "yyyy-MM-dd").alias("event_date"))


def _duck_uuid(hex_expr: str) -> str:
    return (f"substr({hex_expr}, 1, 8) || '-' || substr({hex_expr}, 9, 4) || '-' || substr({hex_expr}, 13, 4) || '-' "
            f"|| substr({hex_expr}, 17, 4) || '-' || substr({hex_expr}, 21, 12)")


@register("i12_normalize_tenant_id", f"""
SELECT input, CASE WHEN regexp_matches(replace(input, '-', ''), '^[0-9a-fA-F]{{32}}$')
                   THEN {_duck_uuid("lower(replace(input, '-', ''))")} ELSE {_duck_uuid('md5(input)')} END AS tenant_uuid
FROM (SELECT c_name AS input FROM customer
      UNION ALL SELECT upper({_duck_uuid('md5(c_name)')}) FROM customer
      UNION ALL SELECT 'T' || CAST(c_custkey % 2 AS VARCHAR) FROM customer) x""")
def i12_normalize_tenant_id(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.fixtures import read_source
    from sessionscope.sources.masters import _dashed, normalize_tenant_id
    c = read_source(spark, sf_dir, "customer")
    inputs = c.select(F.explode(F.array(
        F.col("c_name"), F.upper(_dashed(F.md5("c_name"))),
        F.concat(F.lit("T"), (F.col("c_custkey") % 2).cast("string")))).alias("input"))
    return inputs.select("input", normalize_tenant_id(F.col("input")).alias("tenant_uuid"))


# ---------------------------------------------------------------- I14-I17 sinks
REPLACE_START, REPLACE_END = "2024-01-10", "2024-01-12"
_I14_COLS = ["tenant_id", "event_date", "event_timestamp", "param_ga_session_id", "user_prop_webuserid",
             "param_transaction_id", "ecommerce_purchase_revenue"]


@register("i14_replace_date_range", fixture_sql(f"""
SELECT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_timestamp, param_ga_session_id,
       user_prop_webuserid, param_transaction_id,
       CAST(round(CASE WHEN event_date BETWEEN DATE '{REPLACE_START}' AND DATE '{REPLACE_END}'
                       THEN ecommerce_purchase_revenue ELSE ecommerce_purchase_revenue * 2 END, 2) AS DOUBLE)
         AS ecommerce_purchase_revenue
FROM purchase"""))
def i14_replace_date_range(spark, sf_dir):
    """Load a stale copy (revenue doubled) of the purchase table, then replace the window twice (idempotent)
    with rows re-extracted from the raw export, among them rows of a day outside the window."""
    import uuid
    from pyspark.sql import functions as F
    from sessionscope.functions.text import money
    from sessionscope.session import scratch_dir
    from sessionscope.sources.extract import extract_table
    from sessionscope.sources.sinks import replace_date_range
    t, raw, _, _ = raw_sources(spark, sf_dir)
    path = scratch_dir(spark, f"i14-{uuid.uuid4().hex}", temporary=True) + "/purchase"
    stale = t.purchase.select(*_I14_COLS).withColumn(
        "ecommerce_purchase_revenue", (F.col("ecommerce_purchase_revenue") * 2).cast("decimal(15,2)"))
    stale.write.partitionBy("tenant_id", "event_date").parquet(path)
    fresh = extract_table(raw, "purchase", REPLACE_START, REPLACE_END).select(*_I14_COLS)
    stray = extract_table(raw, "purchase", "2024-01-20", "2024-01-20").select(*_I14_COLS)   # outside the range: left out
    fresh = fresh.unionByName(stray)
    for _ in range(2):
        replace_date_range(spark, path, None, REPLACE_START, REPLACE_END, fresh)
    out = spark.read.parquet(path)
    return out.select("tenant_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
                      "event_timestamp", "param_ga_session_id", "user_prop_webuserid", "param_transaction_id",
                      money(F.col("ecommerce_purchase_revenue")).alias("ecommerce_purchase_revenue"))


_OLD_USERS = """
old_users AS (SELECT 'T' || CAST(c_custkey % 2 AS VARCHAR) AS tenant_id, CAST(c_custkey AS VARCHAR) AS user_id,
                     c_name AS user_name, 'Company ' || CAST(c_custkey % 40 AS VARCHAR) AS buying_company_name,
                     'ERP' || CAST(c_custkey // 4 AS VARCHAR) AS buying_company_erp_id,
                     'old' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email,
                     '+1-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS office_phone,
                     CAST(NULL AS VARCHAR) AS cell_phone, false AS is_active
              FROM customer)"""


@register("i15_upsert_users", fixture_sql("""
SELECT * FROM users
UNION ALL
SELECT * FROM old_users o WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = o.tenant_id AND u.user_id = o.user_id)
""", extra_ctes=_OLD_USERS))
def i15_upsert_users(spark, sf_dir):
    from sessionscope.sources.masters import extract_users
    from sessionscope.sources.sinks import upsert_users
    _, _, master, _ = raw_sources(spark, sf_dir)
    return upsert_users(_old_users(spark, sf_dir), extract_users(master)).select("tenant_id", "user_id", "user_name", "buying_company_name",
                                            "buying_company_erp_id", "email", "office_phone", "cell_phone", "is_active")


def _old_users(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.fixtures import read_source
    c = read_source(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    return c.select(F.concat(F.lit("T"), (ck % 2).cast("string")).alias("tenant_id"), ck.cast("string").alias("user_id"),
                   F.col("c_name").alias("user_name"),
                   F.concat(F.lit("Company "), (ck % 40).cast("string")).alias("buying_company_name"),
                   F.concat(F.lit("ERP"), F.expr("c_custkey div 4").cast("string")).alias("buying_company_erp_id"),
                   F.concat(F.lit("old"), ck.cast("string"), F.lit("@example.org")).alias("email"),
                   F.concat(F.lit("+1-555-"), F.lpad((ck % 10000).cast("string"), 4, "0")).alias("office_phone"),
                   F.lit(None).cast("string").alias("cell_phone"), F.lit(False).alias("is_active"))


@register("i15_bucketed_upsert", fixture_sql("""
SELECT * EXCLUDE (is_active) FROM users
UNION ALL
SELECT * EXCLUDE (is_active) FROM old_users o WHERE NOT EXISTS (SELECT 1 FROM users u WHERE u.tenant_id = o.tenant_id AND u.user_id = o.user_id)
""", extra_ctes=_OLD_USERS))
def i15_bucketed_upsert(spark, sf_dir):
    """I15 on a stored, bucketed table: the old users, then the new master in two batches."""
    import uuid
    from pyspark.sql import functions as F
    from sessionscope.session import scratch_dir
    from sessionscope.sources.buckets import merge_buckets, read_buckets
    from sessionscope.sources.masters import extract_users
    _, _, master, _ = raw_sources(spark, sf_dir)
    old = _old_users(spark, sf_dir)
    path, keys = scratch_dir(spark, f"i15-{uuid.uuid4().hex}", temporary=True) + "/users", ["tenant_id", "user_id"]
    merge_buckets(spark, path, old, keys, buckets=8)
    rows = extract_users(master).withColumn("is_active", F.lit(True)).select(*old.columns)
    for part in (0, 1):
        merge_buckets(spark, path, rows.filter(F.pmod(F.crc32("user_id"), F.lit(2)) == part), keys)
    return read_buckets(spark, path, old.schema).drop("is_active")    # every row came in a batch: all are active


@register("i16_upsert_locations", """
WITH batch AS (
  SELECT t.tenant_id, CAST(n_nationkey AS VARCHAR) AS warehouse_id,
         'D' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS warehouse_code, n_name AS warehouse_name,
         'City ' || CAST(n_nationkey AS VARCHAR) AS city, r_name AS state, true AS is_active,
         CAST(10000 + n_nationkey * 7 AS VARCHAR) AS zip
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('T0'), ('T1')) t(tenant_id)
  WHERE n_nationkey % 5 NOT IN (1, 2)),
old AS (
  SELECT t.tenant_id, CAST(n_nationkey AS VARCHAR) AS warehouse_id,
         'D' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS warehouse_code, n_name AS warehouse_name,
         'Old City' AS city, r_name AS state, false AS is_active, CAST(NULL AS VARCHAR) AS zip
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey CROSS JOIN (VALUES ('T0'), ('T1')) t(tenant_id))
SELECT * FROM batch
UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.tenant_id = o.tenant_id
                                                 AND b.warehouse_id = o.warehouse_id)""")
def i16_upsert_locations(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.masters import normalize_locations
    from sessionscope.sources.sinks import upsert_locations
    t, _, _, locfile = raw_sources(spark, sf_dir)
    old = t.locations.withColumn("city", F.lit("Old City")).withColumn("is_active", F.lit(False))
    batch = normalize_locations(locfile).select(
        F.explode(F.array(F.lit("T0"), F.lit("T1"))).alias("tenant_id"), "*")
    return upsert_locations(old, batch).select("tenant_id", "warehouse_id", "warehouse_code", "warehouse_name",
                                               "city", "state", "is_active", "zip")


@register("i17_ingest_run_summary", fixture_sql("""
SELECT g.tenant_id, g.data_type, CAST(COALESCE(c.records, 0) AS BIGINT) AS records, 'completed' AS status
FROM (SELECT tn.tenant_id, d.data_type FROM (SELECT DISTINCT tenant_id FROM base) tn
      CROSS JOIN (VALUES ('purchase'), ('add_to_cart'), ('page_view'), ('view_search_results'), ('no_search_results'),
                         ('view_item'), ('users_processed'), ('locations_processed')) d(data_type)) g
LEFT JOIN (
  SELECT tenant_id, 'purchase' AS data_type, COUNT(*) AS records FROM purchase GROUP BY 1
  UNION ALL SELECT tenant_id, 'add_to_cart', COUNT(*) FROM add_to_cart GROUP BY 1
  UNION ALL SELECT tenant_id, 'page_view', COUNT(*) FROM page_view GROUP BY 1
  UNION ALL SELECT tenant_id, 'view_search_results', COUNT(*) FROM view_search_results GROUP BY 1
  UNION ALL SELECT tenant_id, 'no_search_results', COUNT(*) FROM no_search_results GROUP BY 1
  UNION ALL SELECT tenant_id, 'view_item', COUNT(*) FROM view_item GROUP BY 1
  UNION ALL SELECT tenant_id, 'users_processed', COUNT(*) FROM users GROUP BY 1
  UNION ALL SELECT t.tenant_id, 'locations_processed', COUNT(*) FROM nation CROSS JOIN (VALUES ('T0'), ('T1')) t(tenant_id)
            WHERE n_nationkey % 5 NOT IN (1, 2) GROUP BY 1
) c ON c.tenant_id = g.tenant_id AND c.data_type = g.data_type"""))
def i17_ingest_run_summary(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.sources.extract import extract_all, reclassify_search_events
    from sessionscope.sources.masters import extract_users, normalize_locations
    from sessionscope.sources.sinks import ingest_run_summary
    t, raw, master, locfile = raw_sources(spark, sf_dir)
    counts = dict(reclassify_search_events(extract_all(raw, None, None)))
    counts["users_processed"] = extract_users(master)
    counts["locations_processed"] = normalize_locations(locfile).select(
        F.explode(F.array(F.lit("T0"), F.lit("T1"))).alias("tenant_id"))
    return ingest_run_summary(counts)


@register("ingest_run", fixture_sql("""
SELECT tenant_id, data_type, CASE WHEN data_type = 'view_item' THEN 0 ELSE records END AS records, 'completed_with_warnings' AS status
FROM (
  SELECT tenant_id, 'purchase' AS data_type, COUNT(*) AS records FROM purchase GROUP BY 1
  UNION ALL SELECT tenant_id, 'add_to_cart', COUNT(*) FROM add_to_cart GROUP BY 1
  UNION ALL SELECT tenant_id, 'page_view', COUNT(*) FROM page_view GROUP BY 1
  UNION ALL SELECT tenant_id, 'view_search_results', COUNT(*) FROM view_search_results GROUP BY 1
  UNION ALL SELECT tenant_id, 'no_search_results', COUNT(*) FROM no_search_results GROUP BY 1
  UNION ALL SELECT tenant_id, 'view_item', COUNT(*) FROM view_item GROUP BY 1
  UNION ALL SELECT tenant_id, 'users_processed', COUNT(*) FROM users GROUP BY 1
  UNION ALL SELECT tenant_id, 'locations_processed', COUNT(*) FROM nation CROSS JOIN (VALUES ('T0'), ('T1')) t(tenant_id)
            WHERE n_nationkey % 5 NOT IN (1, 2) GROUP BY 1)"""))
def ingest_run(spark, sf_dir):
    """A whole run over all days of the data in which the job of one type fails while it runs."""
    import datetime as dt
    import uuid
    from pyspark.sql import functions as F
    from sessionscope.session import scratch_dir
    from sessionscope.sources.extract import extract_table
    from sessionscope.sources.ingest import run_ingest
    from sessionscope.sources.masters import extract_users, normalize_locations
    _, raw, master, locfile = raw_sources(spark, sf_dir)
    lo, hi = (dt.datetime.strptime(x, "%Y%m%d").date().isoformat() for x in raw.agg(F.min("event_date"), F.max("event_date")).first())
    broken = extract_table(raw, "view_item", lo, hi).withColumn("param_page_title", F.raise_error(F.lit("unreadable")).cast("string"))
    locations = normalize_locations(locfile).select(F.explode(F.array(F.lit("T0"), F.lit("T1"))).alias("tenant_id"), "*")
    return run_ingest(spark, scratch_dir(spark, f"ingest-{uuid.uuid4().hex}", temporary=True), lo, hi, raw, extract_users(master), locations,
                      extracted={"view_item": broken}).summary


# ---------------------------------------------------------------- R1-R15 report datasets and rules
def _report_ctes(per_day: bool = True) -> str:
    """Worklist rows of every (tenant, branch[, day]): purchases ``rp``, open carts ``rc`` with their items, searches ``rs``,
    repeat visits ``rr``."""
    day = ", event_date AS report_day" if per_day else ""
    tag = f"*, user_prop_default_branch_id AS report_branch{day}"
    k = "tenant_id, report_branch" + (", report_day" if per_day else "")
    item = ("COALESCE(first_item_quantity, 1)::VARCHAR || 'x ' || COALESCE(first_item_item_name, 'Unknown') || ' (' || COALESCE(first_item_item_id, '') || ')'")
    return f"""
rp AS (SELECT b.*, {_UCOLS} FROM (SELECT {tag} FROM purchase) b {_customer('b')}),
opened AS (SELECT DISTINCT {k}, param_ga_session_id FROM (SELECT {tag} FROM add_to_cart)
           ANTI JOIN purchase USING (tenant_id, param_ga_session_id) WHERE param_ga_session_id IS NOT NULL),
rc AS (SELECT b.*, {_UCOLS} FROM (
         SELECT {k}, param_ga_session_id, user_prop_webuserid, MAX(user_prop_webcustomerid) AS user_prop_webcustomerid,
                SUM(first_item_price * first_item_quantity) AS total_value, array_to_string(list_sort(list({item})), ';') AS items
         FROM opened JOIN add_to_cart USING (tenant_id, param_ga_session_id) GROUP BY ALL) b {_customer('b')}),
searched AS (
  SELECT {k}, param_ga_session_id, user_prop_webuserid, user_prop_webcustomerid, param_no_search_results_term AS term, true AS failed FROM (SELECT {tag} FROM no_search_results)
  UNION ALL
  SELECT {k}, param_ga_session_id, user_prop_webuserid, user_prop_webcustomerid, param_search_term, false
  FROM (SELECT {tag} FROM view_search_results) ANTI JOIN purchase USING (tenant_id, param_ga_session_id)),
rs AS (SELECT b.*, CASE WHEN failed THEN failed_term ELSE nullif(array_to_string(list_sort(terms), ', '), '') END AS search_term, {_UCOLS} FROM (
         SELECT {k}, param_ga_session_id, user_prop_webuserid, failed, CASE WHEN failed THEN term END AS failed_term,
                MAX(user_prop_webcustomerid) AS user_prop_webcustomerid, list(DISTINCT term) AS terms, COUNT(*) AS search_count
         FROM searched GROUP BY ALL HAVING failed OR COUNT(*) > 2) b {_customer('b')}),
rr AS (SELECT b.*, {_UCOLS} FROM (
         SELECT * FROM (
           SELECT {k}, param_ga_session_id, user_prop_webuserid, MAX(user_prop_webcustomerid) AS user_prop_webcustomerid,
                  COUNT(DISTINCT param_page_location) AS page_views_count
           FROM (SELECT {tag} FROM page_view) WHERE user_prop_webuserid IS NOT NULL AND report_branch IS NOT NULL GROUP BY ALL)
         WHERE page_views_count > 2 QUALIFY COUNT(param_ga_session_id) OVER (PARTITION BY {k}, user_prop_webuserid) > 1) b {_customer('b')})
"""


def _r1_sql(per_day: bool = True) -> str:
    k = "tenant_id, report_branch" + (", report_day" if per_day else "")
    day_out = ", strftime(g.report_day, '%Y-%m-%d') AS report_date" if per_day else ""
    kj = " AND ".join(f"x.{c} IS NOT DISTINCT FROM g.{c}" for c in k.split(", "))
    body = f"""
SELECT g.tenant_id, g.report_branch AS branch_code{day_out}, l.warehouse_name AS location_name, l.city, l.state,
       CAST(COALESCE(p.total_purchases, 0) AS BIGINT) AS total_purchases,
       CAST(COALESCE(p.total_revenue, 0) AS DOUBLE) AS total_revenue,
       CAST(COALESCE(p.purchase_unique_customers, 0) AS BIGINT) AS purchase_unique_customers,
       CAST(COALESCE(p.avg_order_value, 0) AS DOUBLE) AS avg_order_value,
       CAST(COALESCE(c.total_cart_abandonment, 0) AS BIGINT) AS total_cart_abandonment,
       CAST(COALESCE(c.cart_unique_customers, 0) AS BIGINT) AS cart_unique_customers,
       CAST(COALESCE(c.cart_total_value, 0) AS DOUBLE) AS cart_total_value,
       CAST(COALESCE(c.cart_avg_value, 0) AS DOUBLE) AS cart_avg_value,
       CAST(COALESCE(s.total_search_issues, 0) AS BIGINT) AS total_search_issues,
       CAST(COALESCE(s.search_total_searches, 0) AS BIGINT) AS search_total_searches,
       CAST(COALESCE(s.search_affected_sessions, 0) AS BIGINT) AS search_affected_sessions,
       CAST(COALESCE(s.search_unique_users, 0) AS BIGINT) AS search_unique_users,
       CAST(COALESCE(r.total_repeat_visits, 0) AS BIGINT) AS total_repeat_visits,
       CAST(COALESCE(r.repeat_avg_pages, 0) AS DOUBLE) AS repeat_avg_pages
FROM (SELECT {k} FROM rp UNION SELECT {k} FROM rc UNION SELECT {k} FROM rs UNION SELECT {k} FROM rr) g
LEFT JOIN (SELECT {k}, COUNT(*) AS total_purchases,
                  CAST(SUM(CAST(round(COALESCE(ecommerce_purchase_revenue, 0), 2) AS DECIMAL(20,2))) AS DOUBLE) AS total_revenue,
                  COUNT(DISTINCT CASE WHEN user_id <> '' THEN user_id END) AS purchase_unique_customers,
                  CAST(SUM(CAST(round(COALESCE(ecommerce_purchase_revenue, 0), 2) AS DECIMAL(20,2))) AS DOUBLE)
                    / CAST(greatest(COUNT(*), 1) AS DOUBLE) AS avg_order_value
           FROM rp GROUP BY ALL) p ON {kj.replace('x.', 'p.')}
LEFT JOIN (SELECT {k}, COUNT(*) AS total_cart_abandonment,
                  COUNT(DISTINCT CASE WHEN user_id <> '' THEN user_id END) AS cart_unique_customers,
                  CAST(SUM(CAST(round(COALESCE(total_value, 0), 2) AS DECIMAL(20,2))) AS DOUBLE) AS cart_total_value,
                  CAST(SUM(CAST(round(COALESCE(total_value, 0), 2) AS DECIMAL(20,2))) AS DOUBLE)
                    / CAST(greatest(COUNT(*), 1) AS DOUBLE) AS cart_avg_value
           FROM rc GROUP BY ALL) c ON {kj.replace('x.', 'c.')}
LEFT JOIN (SELECT {k}, COUNT(*) AS total_search_issues, SUM(search_count) AS search_total_searches,
                  COUNT(DISTINCT CASE WHEN param_ga_session_id <> '' THEN param_ga_session_id END) AS search_affected_sessions,
                  COUNT(DISTINCT CASE WHEN user_id <> '' THEN user_id END) AS search_unique_users
           FROM rs GROUP BY ALL) s ON {kj.replace('x.', 's.')}
LEFT JOIN (SELECT {k}, COUNT(*) AS total_repeat_visits,
                  CAST(SUM(page_views_count) AS DOUBLE) / CAST(greatest(COUNT(*), 1) AS DOUBLE) AS repeat_avg_pages
           FROM rr GROUP BY ALL) r ON {kj.replace('x.', 'r.')}
LEFT JOIN locations l ON l.tenant_id = g.tenant_id AND l.warehouse_code = g.report_branch"""
    return fixture_sql(body, extra_ctes=_report_ctes(per_day))


@register("r1_branch_report_summary", _r1_sql(True))
def r1_branch_report_summary(spark, sf_dir):
    from sessionscope.plans.report import branch_report_summary
    return branch_report_summary(tables(spark, sf_dir))


_R_PARTS = {
    "r2_purchase_rollup": ["total_purchases", "total_revenue", "purchase_unique_customers", "avg_order_value"],
    "r3_cart_rollup": ["total_cart_abandonment", "cart_unique_customers", "cart_total_value", "cart_avg_value"],
    "r4_search_rollup": ["total_search_issues", "search_total_searches", "search_affected_sessions",
                         "search_unique_users"],
    "r6_repeat_rollup": ["total_repeat_visits", "repeat_avg_pages"],
}


def _r_part(worklist, cols):
    def fn(spark, sf_dir):
        from sessionscope.plans.report import branch_rollup
        return branch_rollup(worklist, tables(spark, sf_dir), per_day=False)
    sql = f"SELECT tenant_id, branch_code, {', '.join(cols)} FROM ({_r1_sql(False)}) x WHERE {cols[0]} > 0"
    return fn, sql


for (_k, _cols), _w in zip(_R_PARTS.items(), ("purchases", "carts", "searches", "repeats"), strict=True):
    _fn, _sql = _r_part(_w, _cols)
    register(_k, _sql)(_fn)


@register("r5_search_term_samples", fixture_sql("""
SELECT * FROM (
  SELECT tenant_id, report_branch AS branch_code, strftime(report_day, '%Y-%m-%d') AS report_date, search_term,
         COUNT(*) AS total_searches,
         COUNT(DISTINCT CASE WHEN param_ga_session_id <> '' THEN param_ga_session_id END) AS unique_sessions,
         COALESCE(string_agg(CASE WHEN customer_name IS NOT NULL AND customer_name <> ''
                                  THEN customer_name || '|' || COALESCE(email, '') || '|' || COALESCE(phone, '') END,
                             ';' ORDER BY CASE WHEN customer_name IS NOT NULL AND customer_name <> ''
                                  THEN customer_name || '|' || COALESCE(email, '') || '|' || COALESCE(phone, '') END), '') AS user_details,
         row_number() OVER (PARTITION BY tenant_id, report_branch, report_day
                            ORDER BY COUNT(*) DESC, search_term ASC NULLS FIRST) AS rank
  FROM rs GROUP BY tenant_id, report_branch, report_day, search_term) x WHERE rank <= 10""",
    extra_ctes=_report_ctes(True)))
def r5_search_term_samples(spark, sf_dir):
    from sessionscope.plans.report import search_term_samples
    return search_term_samples(tables(spark, sf_dir))


@register("r7_repeat_samples", fixture_sql("""
SELECT rr.tenant_id, rr.report_branch AS branch_code, rr.param_ga_session_id AS session_id, rr.customer_name AS customer,
       rr.email, rr.page_views_count AS pages_viewed, COALESCE(p.pages_summary, '') AS pages_summary
FROM rr LEFT JOIN (
  SELECT tenant_id, param_ga_session_id,
         array_to_string(list_slice(list(COALESCE(title, 'Unknown Product') || '|' || COALESCE(url, '#') || '|'
                                          || COALESCE(category, '') || '|' || COALESCE(CAST(price AS VARCHAR), '0')
                                          ORDER BY title, url, category, price), 1, 5), ';') AS pages_summary
  FROM (SELECT DISTINCT tenant_id, param_ga_session_id, COALESCE(first_item_item_name, first_item_item_id) AS title,
               param_page_location AS url, first_item_item_category AS category, first_item_price AS price
        FROM view_item WHERE first_item_item_id IS NOT NULL) d
  GROUP BY 1, 2) p ON p.tenant_id = rr.tenant_id AND p.param_ga_session_id = rr.param_ga_session_id""",
    extra_ctes=_report_ctes(False)))
def r7_repeat_samples(spark, sf_dir):
    from sessionscope.plans.report import repeat_samples
    return repeat_samples(tables(spark, sf_dir), per_day=False)


@register("r8_purchase_and_cart_samples", fixture_sql("""
SELECT tenant_id, report_branch AS branch_code, strftime(report_day, '%Y-%m-%d') AS report_date, 'purchase' AS kind,
       param_transaction_id AS ref_id, customer_name,
       CAST(round(COALESCE(ecommerce_purchase_revenue, 0), 2) AS DOUBLE) AS value, email,
       CASE WHEN phone IS NOT NULL AND phone <> '' THEN phone ELSE office_phone END AS phone,
       array_to_string(list_transform(COALESCE(from_json(COALESCE(items_json, '[]'),
                         '[{"item_id":"VARCHAR","item_name":"VARCHAR","quantity":"BIGINT"}]'), []),
                       lambda e: CAST(COALESCE(e.quantity, 1) AS VARCHAR) || 'x ' || COALESCE(e.item_name, 'Unknown')
                            || ' (' || COALESCE(e.item_id, '') || ')'), ';') AS products
FROM rp
UNION ALL
SELECT rc.tenant_id, rc.report_branch, strftime(rc.report_day, '%Y-%m-%d'), 'cart', rc.param_ga_session_id, rc.customer_name,
       CAST(COALESCE(round(rc.total_value, 2), 0) AS DOUBLE), rc.email,
       CASE WHEN rc.phone IS NOT NULL AND rc.phone <> '' THEN rc.phone ELSE rc.office_phone END,
       rc.items
FROM rc""", extra_ctes=_report_ctes(True)))
def r8_purchase_and_cart_samples(spark, sf_dir):
    from sessionscope.plans.report import purchase_and_cart_samples
    return purchase_and_cart_samples(tables(spark, sf_dir))


@register("r9_dispatch_plan", fixture_sql("""
SELECT j.tenant_id, j.job_id, j.branch_code, m.sales_rep_email, m.sales_rep_name,
       'Daily Branch Sales Report - ' || strftime(j.report_date, '%Y-%m-%d') || ' - ' || j.branch_code AS subject,
       l.warehouse_name AS location_name
FROM (SELECT tenant_id, job_id, report_date, unnest(target_branches) AS branch_code FROM email_sending_jobs) j
JOIN branch_email_mappings m ON m.tenant_id = j.tenant_id AND m.branch_code = j.branch_code AND m.is_enabled
LEFT JOIN locations l ON l.tenant_id = j.tenant_id AND l.warehouse_code = j.branch_code"""))
def r9_dispatch_plan(spark, sf_dir):
    from sessionscope.plans.report import dispatch_plan
    return dispatch_plan(tables(spark, sf_dir))


AS_OF_EVENTS = "2024-01-31 00:00:00"
_HOURS = f"floor(epoch(TIMESTAMP '{AS_OF_EVENTS}' - CAST(CAST(event_date AS DATE) AS TIMESTAMP)) / 3600)"


@register("r11_purchase_priority", f"""
SELECT tenant_id, transaction_id, user_id, order_value, event_date,
       CASE WHEN COALESCE(order_value, 0) > 1000 OR (COALESCE(order_value, 0) > 500 AND {_HOURS} < 24) THEN 'high'
            WHEN COALESCE(order_value, 0) < 100 OR {_HOURS} > 168 THEN 'low' ELSE 'medium' END AS priority
FROM ({q4_sql()}) x""")
def r11_purchase_priority(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.plans.report import purchase_priority
    from sessionscope.plans.worklists import purchase_tasks
    p = purchase_tasks(tables(spark, sf_dir))
    return p.select("tenant_id", "transaction_id", "user_id", "order_value", "event_date",
                    purchase_priority(F.col("order_value"), F.col("event_date"), AS_OF_EVENTS).alias("priority"))


@register("r12_cart_priority", f"""
SELECT tenant_id, session_id, user_id, total_value, event_date,
       CASE WHEN COALESCE(total_value, 0) > 500 OR (COALESCE(total_value, 0) > 200 AND {_HOURS} < 24) THEN 'high'
            WHEN COALESCE(total_value, 0) < 50 OR {_HOURS} > 72 THEN 'low' ELSE 'medium' END AS priority
FROM ({Q5_SQL}) x""")
def r12_cart_priority(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.plans.report import cart_priority
    from sessionscope.plans.worklists import cart_abandonment_tasks
    c = cart_abandonment_tasks(tables(spark, sf_dir))
    return c.select("tenant_id", "session_id", "user_id", "total_value", "event_date",
                    cart_priority(F.col("total_value"), F.col("event_date"), AS_OF_EVENTS).alias("priority"))


@register("r13_repeat_priority", f"""
SELECT tenant_id, session_id, user_id, page_views_count, products_viewed, event_date,
       CASE WHEN (page_views_count > 10 AND products_viewed > 5) OR (page_views_count > 15 AND floor({_HOURS} / 24) < 3) THEN 'high'
            WHEN page_views_count > 5 OR products_viewed > 2 OR floor({_HOURS} / 24) < 7 THEN 'medium' ELSE 'low' END AS priority
FROM ({Q7_SQL}) x""")
def r13_repeat_priority(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.plans.report import repeat_priority
    from sessionscope.plans.worklists import repeat_visit_tasks
    r = repeat_visit_tasks(tables(spark, sf_dir))
    return r.select("tenant_id", "session_id", "user_id", "page_views_count", "products_viewed", "event_date",
                    repeat_priority(F.col("page_views_count"), F.col("products_viewed"), F.col("event_date"),
                                    AS_OF_EVENTS).alias("priority"))


@register("r14_search_priority", f"""
SELECT tenant_id, session_id, user_id, search_type, search_count, search_term,
       CASE WHEN search_type = 'no_results' AND search_count > 3 THEN 'high'
            WHEN search_type = 'no_results' AND search_count <= 1 THEN 'low'
            WHEN COALESCE(search_type, '') <> 'no_results' AND search_count > 5 THEN 'high'
            WHEN COALESCE(search_type, '') <> 'no_results' AND search_count <= 2 THEN 'low' ELSE 'medium' END AS priority
FROM ({Q6_SQL}) x""")
def r14_search_priority(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.plans.report import search_priority
    from sessionscope.plans.worklists import search_analysis_tasks
    s = search_analysis_tasks(tables(spark, sf_dir))
    return s.select("tenant_id", "session_id", "user_id", "search_type", "search_count", "search_term",
                    search_priority(F.col("search_type"), F.col("search_count")).alias("priority"))


def _text(path: str, default: str) -> str:
    return f"COALESCE(nullif(json_extract_string(details, '$.{path}'), ''), '{default}')"


def _dec(path: str, kind: str = "DECIMAL(15,2)") -> str:
    return f"COALESCE(json_extract_string(details, '$.{path}')::{kind}, 0)"


@register("r15_history_projection", fixture_sql(f"""
SELECT tenant_id, user_id, section, row_number() OVER sections AS position, event_timestamp,
       strftime(make_timestamp(event_timestamp::BIGINT), '%Y%m%d') AS event_day,
       CASE event_type WHEN 'purchase' THEN {_text('transaction_id', 'unknown')} WHEN 'add_to_cart' THEN COALESCE(nullif(session_id, ''), 'unknown')
            WHEN 'view_item' THEN {_text('item_id', 'unknown')} WHEN 'page_view' THEN COALESCE(nullif(string_split(page, '/')[-1], ''), 'unknown')
            ELSE {_text('search_term', 'unknown')} END AS item_key,
       CASE event_type WHEN 'view_item' THEN {_text('item_name', 'Unknown Product')} WHEN 'page_view' THEN {_text('page_title', 'Unknown Product')} END AS name,
       CASE event_type WHEN 'view_item' THEN {_text('category', 'Product')} WHEN 'page_view' THEN 'Product' END AS category,
       round(CASE event_type WHEN 'purchase' THEN {_dec('revenue')}::DOUBLE WHEN 'add_to_cart' THEN {_dec('price')}::DOUBLE * {_dec('quantity')}::DOUBLE
                             WHEN 'view_search_results' THEN 1.0 WHEN 'view_item' THEN {_dec('price')}::DOUBLE ELSE 0.0 END, 2) AS value,
       CASE event_type WHEN 'purchase' THEN {_text('items', '[]')}
            WHEN 'add_to_cart' THEN concat_ws('|', {_text('item_name', 'Unknown Item')}, {_text('item_id', 'unknown')}, {_dec('quantity', 'INTEGER')}::VARCHAR, {_dec('price', 'DECIMAL(10,2)')}::VARCHAR)
            END AS items,
       CASE WHEN event_type IN ('view_item', 'page_view') THEN 1 END AS view_count
FROM (
  SELECT tenant_id, user_id, moment AS event_timestamp, sid AS session_id, kind AS event_type, shown AS details, section, json_extract_string(shown, '$.page_location') AS page
  FROM ({_WATCHED}) w
  JOIN (VALUES ('purchase', 'purchases'), ('add_to_cart', 'carts'), ('view_search_results', 'searches'), ('no_search_results', 'searches'),
               ('view_item', 'viewed_products'), ('page_view', 'viewed_products')) s(kind, section) USING (kind))
WHERE event_type <> 'page_view' OR contains(page, '/product/')
WINDOW sections AS (PARTITION BY tenant_id, user_id, section ORDER BY event_timestamp, event_type, details)
QUALIFY position <= CASE section WHEN 'purchases' THEN 5 WHEN 'carts' THEN 5 ELSE 10 END
""", extra_ctes=_TIMELINE))
def r15_history_projection(spark, sf_dir):
    from sessionscope.plans.history import user_history
    from sessionscope.plans.report import history_projection
    return history_projection(user_history(tables(spark, sf_dir), ordered=False))


# ---------------------------------------------------------------- building blocks (P/J/A/W/L/U/S)
def _block(name, *args, raw=False):
    def fn(spark, sf_dir):
        from sessionscope.plans import blocks
        if raw:
            _, r, _, _ = raw_sources(spark, sf_dir)
            return getattr(blocks, name)(r, *args)
        return getattr(blocks, name)(tables(spark, sf_dir), *args)
    return fn


register("j1_identity_resolution_join", fixture_sql(f"""
SELECT p.tenant_id, p.event_id, u.user_id FROM purchase p {_customer('p')}"""))(_block("identity_pairs"))

register("j2_anti_join_no_purchase", fixture_sql(f"""
SELECT ac.tenant_id, ac.event_id FROM add_to_cart ac WHERE {_NO_PURCHASE.format(a='ac')}"""))(
    _block("carts_without_purchase"))

register("j3_semi_join_sessions", fixture_sql("""
SELECT pv.tenant_id, pv.event_id FROM page_view pv
WHERE pv.param_ga_session_id IN (SELECT param_ga_session_id FROM add_to_cart ac WHERE ac.tenant_id = pv.tenant_id)"""))(
    _block("page_views_in_cart_sessions"))

register("a1_sum_revenue", fixture_sql("""
SELECT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date,
       CAST(round(COALESCE(SUM(ecommerce_purchase_revenue), 0), 2) AS DOUBLE) AS revenue,
       CASE WHEN SUM(ecommerce_purchase_revenue) IS NULL THEN '$0' ELSE '$' || CAST(SUM(ecommerce_purchase_revenue) AS VARCHAR) END
         AS revenue_label
FROM purchase GROUP BY tenant_id, event_date"""))(_block("revenue_per_day"))

register("a2_count_rows", fixture_sql("""
SELECT tenant_id, COUNT(*) AS rows, 'purchase' AS table_name FROM purchase GROUP BY 1
UNION ALL SELECT tenant_id, COUNT(*), 'add_to_cart' FROM add_to_cart GROUP BY 1
UNION ALL SELECT tenant_id, COUNT(*), 'page_view' FROM page_view GROUP BY 1
UNION ALL SELECT tenant_id, COUNT(*), 'view_search_results' FROM view_search_results GROUP BY 1
UNION ALL SELECT tenant_id, COUNT(*), 'no_search_results' FROM no_search_results GROUP BY 1
UNION ALL SELECT tenant_id, COUNT(*), 'view_item' FROM view_item GROUP BY 1"""))(_block("rows_per_table"))

register("a3_count_distinct", fixture_sql("""
SELECT tenant_id, COUNT(DISTINCT param_ga_session_id) AS sessions, COUNT(DISTINCT user_prop_webuserid) AS users,
       COUNT(DISTINCT param_page_location) AS pages FROM page_view GROUP BY tenant_id"""))(_block("distinct_counts"))

register("a4_max_last_activity", fixture_sql("""
SELECT tenant_id, param_ga_session_id, user_prop_webuserid, MAX(event_timestamp) AS last_activity,
       MAX(user_prop_webcustomerid) AS max_customer FROM page_view GROUP BY 1, 2, 3"""))(
    _block("session_last_activity"))

register("a6_having_threshold", fixture_sql("""
SELECT tenant_id, user_prop_webuserid, COUNT(DISTINCT param_ga_session_id) AS sessions FROM page_view
WHERE user_prop_webuserid IS NOT NULL GROUP BY 1, 2 HAVING COUNT(DISTINCT param_ga_session_id) > 1"""))(
    _block("multi_session_users"))

register("a7_sum_of_product", fixture_sql("""
SELECT tenant_id, param_ga_session_id, CAST(round(SUM(first_item_price * first_item_quantity), 2) AS DOUBLE) AS cart_value
FROM add_to_cart GROUP BY 1, 2"""))(_block("cart_value_per_session"))

register("a8_collect_structs", fixture_sql("""
SELECT tenant_id, param_ga_session_id, string_agg(item, ';' ORDER BY item) AS products FROM (
  SELECT tenant_id, param_ga_session_id,
         COALESCE(first_item_item_id, '') || '|' || COALESCE(first_item_item_name, '') || '|'
         || COALESCE(first_item_item_category, '') || '|' || COALESCE(CAST(first_item_price AS VARCHAR), '') || '|'
         || COALESCE(CAST(first_item_quantity AS VARCHAR), '') || 'x' || CAST(COUNT(*) AS VARCHAR) AS item
  FROM add_to_cart GROUP BY tenant_id, param_ga_session_id, first_item_item_id, first_item_item_name,
       first_item_item_category, first_item_price, first_item_quantity) x GROUP BY 1, 2"""))(
    _block("cart_items_per_session"))

register("a9_collect_distinct_filtered", fixture_sql("""
SELECT c.tenant_id, c.param_ga_session_id, c.products_viewed, d.products_details FROM
  (SELECT tenant_id, param_ga_session_id, COUNT(DISTINCT first_item_item_id) AS products_viewed FROM view_item
   WHERE first_item_item_id IS NOT NULL AND param_ga_session_id IS NOT NULL GROUP BY 1, 2) c
JOIN (SELECT tenant_id, param_ga_session_id, string_agg(item, ';' ORDER BY item) AS products_details FROM (
        SELECT DISTINCT tenant_id, param_ga_session_id,
               COALESCE(COALESCE(first_item_item_name, first_item_item_id), '') || '|' || COALESCE(param_page_location, '')
               || '|' || COALESCE(first_item_item_category, '') || '|' || COALESCE(CAST(first_item_price AS VARCHAR), '')
               || 'x1' AS item
        FROM view_item WHERE first_item_item_id IS NOT NULL) i GROUP BY 1, 2) d
ON c.tenant_id = d.tenant_id AND c.param_ga_session_id = d.param_ga_session_id"""))(
    _block("viewed_products_per_session"))

register("a10_string_agg_distinct", fixture_sql("""
SELECT tenant_id, param_ga_session_id, STRING_AGG(DISTINCT param_search_term, ', ' ORDER BY param_search_term) AS terms
FROM view_search_results GROUP BY 1, 2"""))(_block("search_terms_per_session"))

register("a11_first_by_order", fixture_sql("""
SELECT tenant_id, param_ga_session_id, user_prop_webuserid,
       first(param_page_location ORDER BY event_timestamp, event_id) AS entry_page FROM page_view GROUP BY 1, 2, 3"""))(
    _block("entry_pages"))

register("a12_two_level_aggregation", fixture_sql("""
SELECT tenant_id, branch, CAST(SUM(n) AS BIGINT) AS visitors,
       COUNT(CASE WHEN n > 1 AND user_prop_webuserid IS NOT NULL THEN 1 END) AS repeat_users FROM (
  SELECT tenant_id, user_prop_default_branch_id AS branch, user_prop_webuserid, COUNT(DISTINCT param_ga_session_id) AS n
  FROM page_view GROUP BY 1, 2, 3) x GROUP BY 1, 2"""))(_block("branch_visitor_levels"))

register("a14_ratio_rounded", fixture_sql("""
SELECT v.tenant_id, strftime(v.event_date, '%Y-%m-%d') AS event_date,
       CAST(CASE WHEN v.visitors > 0 THEN round(COALESCE(p.purchases, 0) * 100.0 / v.visitors, 2) ELSE 0 END AS DOUBLE)
         AS conversion_rate
FROM (SELECT tenant_id, event_date, COUNT(DISTINCT param_ga_session_id) AS visitors FROM page_view GROUP BY 1, 2) v
LEFT JOIN (SELECT tenant_id, event_date, COUNT(*) AS purchases FROM purchase GROUP BY 1, 2) p
ON v.tenant_id = p.tenant_id AND v.event_date = p.event_date"""))(_block("conversion_per_day"))

register("w1_total_count_over", fixture_sql("""
SELECT tenant_id, event_id, COUNT(*) OVER (PARTITION BY tenant_id) AS total_count FROM purchase"""))(
    _block("purchase_totals"))

register("w2_top_n_per_group", fixture_sql("""
SELECT * FROM (SELECT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_id,
                      CAST(round(ecommerce_purchase_revenue, 2) AS DOUBLE) AS revenue,
                      row_number() OVER (PARTITION BY tenant_id, event_date
                                         ORDER BY ecommerce_purchase_revenue DESC NULLS LAST, event_id ASC) AS rank
               FROM purchase) x WHERE rank <= 3"""))(_block("top_purchases_per_day"))

register("u5_distinct", fixture_sql("""
SELECT DISTINCT tenant_id, param_ga_session_id FROM add_to_cart WHERE param_ga_session_id IS NOT NULL"""))(
    _block("cart_sessions"))


def _event_times_sql() -> str:
    ts = "make_timestamp(CAST(event_timestamp AS BIGINT))"
    cols = []
    for g in ("hourly", "4hours", "12hours", "daily", "weekly", "monthly"):
        s_, lab = _duck_bucket(ts, g)
        cols.append(f"strftime({s_}, '%Y-%m-%d %H:%M:%S') AS start_{g}, {lab} AS label_{g}")
    return fixture_sql(f"""
SELECT tenant_id, event_id, strftime({ts}, '%Y-%m-%d') AS event_day, {', '.join(cols)}
FROM page_view WHERE regexp_matches(event_timestamp, '^[0-9]+$')""")


register("s1_s4_event_time_buckets", _event_times_sql())(_block("event_times"))

register("s5_date_spine", fixture_sql(f"""
SELECT DISTINCT tenant_id, {_duck_bucket('p', '4hours')[1]} AS date_group FROM (
  SELECT tenant_id, unnest(generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP) + INTERVAL '23 hours 59 minutes 59 seconds',
                                           INTERVAL 4 HOUR)) AS p
  FROM (SELECT tenant_id, MIN(event_date) AS s, MAX(event_date) AS e FROM page_view GROUP BY 1) r) x"""))(
    _block("data_spine"))

register("s6_parse_date", fixture_sql("""
SELECT id, strftime(report_date, '%Y-%m-%d') AS report_text, date_diff('day', DATE '2000-01-01', report_date) AS days
FROM email_send_history"""))(_block("report_dates"))

register("s8_currency_parse_format", fixture_sql("""
SELECT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, CAST(COALESCE(SUM(ecommerce_purchase_revenue), 0) AS DOUBLE) AS parsed,
       '$' || format('{:,.2f}', CAST(COALESCE(SUM(ecommerce_purchase_revenue), 0) AS DOUBLE)) AS formatted
FROM purchase GROUP BY tenant_id, event_date"""))(_block("currency_round_trip"))

register("s9_null_defaults", fixture_sql("""
SELECT tenant_id, event_id, COALESCE(param_page_location, '') AS page_location,
       CAST(round(COALESCE(ecommerce_purchase_revenue, 0), 2) AS DOUBLE) AS order_value,
       COALESCE(items_json, '[]') AS products FROM purchase"""))(_block("null_defaults"))

register("s10_s13_nested_lookups", fixture_sql("""
SELECT tenant_id, CAST(event_timestamp AS BIGINT) AS event_timestamp, event_name,
       user_prop_webuserid AS webuserid, param_ga_session_id AS session_id, param_page_title AS page_title,
       user_prop_default_branch_id AS branch,
       CASE WHEN event_name IN ('purchase', 'add_to_cart', 'view_item') THEN 'P' || CAST(k AS VARCHAR) END AS first_item_id,
       CASE WHEN event_name IN ('purchase', 'add_to_cart', 'view_item') THEN 1 ELSE 0 END AS items,
       to_json({'category': device_category, 'operating_system': device_operating_system})::VARCHAR AS device_json
FROM (SELECT *, unnest(CASE WHEN event_type = 'purchase' THEN ['purchase'] WHEN event_type = 'click' THEN ['add_to_cart']
                            WHEN event_type = 'view' THEN ['page_view'] WHEN event_type = 'signup' THEN ['page_view', 'view_item']
                            WHEN k % 3 = 2 THEN ['view_search_results'] WHEN k % 6 = 0 THEN ['view_search_results_no_results']
                            ELSE ['no_search_results'] END) AS event_name FROM base) b"""))(
    _block("raw_lookups", raw=True))

register("s14_json_parse_products", fixture_sql("""
SELECT tenant_id, event_id,
       array_to_string(list_transform(COALESCE(from_json(items_json,
                         '[{"item_id":"VARCHAR","item_name":"VARCHAR","quantity":"BIGINT"}]'), []),
                       lambda e: CAST(COALESCE(e.quantity, 1) AS VARCHAR) || 'x ' || COALESCE(e.item_name, 'Unknown')
                            || ' (' || COALESCE(e.item_id, '') || ')'), ';') AS products FROM purchase"""))(
    _block("parsed_purchase_products"))

register("s15_duration_label", "SELECT tenant_id, job_id, duration FROM (" + QUERIES["a15_map_values_sum"][1] + ") x")(
    _block("job_durations"))

register("s16_days_ago_label", fixture_sql(f"""
SELECT DISTINCT tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date,
       CASE date_diff('day', event_date, DATE '{AS_OF_EVENTS[:10]}') WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday'
            ELSE CAST(date_diff('day', event_date, DATE '{AS_OF_EVENTS[:10]}') AS VARCHAR) || ' days ago' END AS label
FROM page_view"""))(_block("visit_age_labels", AS_OF_EVENTS))

register("s17_url_last_segment", fixture_sql("""
SELECT tenant_id, event_id, CASE WHEN contains(param_page_location, '/product/')
                                 THEN string_split(param_page_location, '/')[-1] END AS sku FROM page_view"""))(
    _block("product_skus"))


# ---------------------------------------------------------------- parameterised variants (P*, L*, Q18)
def _q(fn_name, **kw):
    def fn(spark, sf_dir):
        from sessionscope.plans import worklists, overview, chart, jobs
        mod = {"purchase_tasks": worklists, "cart_abandonment_tasks": worklists, "search_analysis_tasks": worklists,
               "repeat_visit_tasks": worklists, "overview_stats": overview, "chart_data": chart,
               "email_history_page": jobs}[fn_name]
        return getattr(mod, fn_name)(tables(spark, sf_dir), **kw)
    return fn


register("p1_tenant_filter", "SELECT * FROM (" + Q1_SQL + ") x WHERE tenant_id = 'T1'")(
    _q("overview_stats", start=START, end=END, tenant_id="T1"))

register("p2_optional_location_filter", q1_sql(_in_range() + " AND user_prop_default_branch_id = 'D05'"))(
    _q("overview_stats", start=START, end=END, location_id="D05"))

register("p3_optional_date_range", q4_sql().replace(
    "FROM purchase fp " + _customer('fp'), "FROM purchase fp " + _customer('fp') + " WHERE fp.event_date >= DATE '2024-01-15'"))(
    _q("purchase_tasks", start="2024-01-15"))

register("p4_mandatory_date_between", q2_sql("daily", "2024-01-08", "2024-01-14"))(
    _q("chart_data", start="2024-01-08", end="2024-01-14", granularity="daily"))

register("p5_ilike_contains", q6_sql(failed="{c} ILIKE '%TERM 1%'", found="{c} ILIKE '%TERM 1%'"))(
    _q("search_analysis_tasks", query="TERM 1"))

register("p6_multi_column_search", q5_sql(
    "(SELECT ac.* FROM add_to_cart ac " + _customer('ac') + " WHERE u.buying_company_name ILIKE '%company 1%' "
    "OR u.email ILIKE '%company 1%' OR ac.first_item_item_name ILIKE '%company 1%')"))(_q("cart_abandonment_tasks", query="company 1"))

register("p7_json_text_search", "SELECT * FROM (" + q4_sql().replace(
    "FROM purchase fp " + _customer('fp'), "FROM purchase fp " + _customer('fp') + " WHERE fp.items_json ILIKE '%item 7%'")
    + ") x")(_q("purchase_tasks", query="item 7"))

INDEXED_PATTERNS = ("item 7", "ITEM%3", "p1_", "em")


@register("p7_indexed_search", fixture_sql(f"""
SELECT q AS pattern, tenant_id, event_id FROM purchase, (VALUES {', '.join(f"('{q}')" for q in INDEXED_PATTERNS)}) asked(q) WHERE items_json ILIKE '%' || q || '%'"""))
def p7_indexed_search(spark, sf_dir):
    """The purchases whose items match each pattern, through the trigram index of the stored table."""
    import uuid
    from functools import reduce
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F
    from sessionscope.operators.textindex import add_to_index, search
    from sessionscope.session import scratch_dir
    purchase = tables(spark, sf_dir).purchase
    index = scratch_dir(spark, f"p7-{uuid.uuid4().hex}", temporary=True)
    add_to_index(purchase, "items_json", index)
    return reduce(DataFrame.unionByName, [search(purchase, "items_json", q, index).select(F.lit(q).alias("pattern"), "tenant_id", "event_id") for q in INDEXED_PATTERNS])


register("p10_status_filter", fixture_sql(_page_sql(f"""
SELECT tenant_id, id, job_id, branch_code, sales_rep_email, sales_rep_name, subject,
       strftime(report_date, '%Y-%m-%d') AS report_date, status, smtp_response, error_message,
       {_TS.format(c='sent_at')} AS sent_at, COUNT(*) OVER (PARTITION BY tenant_id) AS total_count
FROM email_send_history WHERE branch_code = 'D03' AND status = 'failed'
  AND report_date >= DATE '1995-01-01' AND report_date <= DATE '1999-12-31'""", "sent_at DESC, id ASC", 50, 0)))(
    _q("email_history_page", limit=50, offset=0, branch_code="D03", status="failed", start="1995-01-01",
       end="1999-12-31"))

register("l1_dynamic_sort", q4_sql(1, 20).replace(
    "ORDER BY fp.event_timestamp DESC NULLS FIRST",
    "ORDER BY fp.ecommerce_purchase_revenue ASC NULLS LAST, fp.event_timestamp DESC NULLS FIRST"))(
    _q("purchase_tasks", page=1, limit=20, sort_field="order_value", sort_order="asc"))

register("l2_limit_offset_page", q4_sql(2, 25))(_q("purchase_tasks", page=2, limit=25))


@register("q18_page_envelope", fixture_sql("""
SELECT tenant_id, CASE WHEN n > 25 THEN n END AS total, CAST(2 AS BIGINT) AS page, CAST(25 AS BIGINT) AS "limit",
       CASE WHEN n > 25 THEN 50 < n END AS has_more
FROM (SELECT p.tenant_id, COUNT(*) AS n FROM purchase p """ + _customer('p') + """ GROUP BY p.tenant_id) x"""))
def q18_page_envelope(spark, sf_dir):
    from pyspark.sql import functions as F
    from sessionscope.operators.paging import page_envelope
    from sessionscope.plans.worklists import purchase_tasks
    totals = purchase_tasks(tables(spark, sf_dir)).groupBy("tenant_id").agg(F.max("total_count").alias("total_count"))
    return page_envelope(totals, page=2, limit=25)


# Operators exercised inside a registered analytic query (same plan, same oracle).
ALIASES = {
    "p8_regex_digits_guard": "q2_chart_data_hourly",
    "p9_active_flag_filter": "q13_locations_list",
    "p11_status_in_and_age": "q19_stuck_jobs",
    "p12_computed_projection": "q4_purchase_tasks",
    "j4_inner_join_repeat_users": "q7_repeat_visit_tasks",
    "j5_multiway_left_join_dimension": "q3_location_stats",
    "j6_single_row_aggregates_per_tenant": "q1_overview_stats",
    "j7_spine_left_join": "q2_chart_data_daily",
    "j9_mapping_to_branch_join": "r9_dispatch_plan",
    "a5_min_max_dates": "q14_data_availability",
    "a13_facet_counts": "q6_search_facets",
    "l3_offset_page_raw": "q15_ingestion_jobs_page",
    "l4_top_10_pages": "q9_performance_bounced_pages",
    "l5_top_10_terms": "r5_search_term_samples",
    "l6_ordered_timeline": "q12_session_history",
    "u2_union_all_search_types": "q6_search_analysis_tasks",
    "u3_union_all_sum": "q2_chart_data_daily",
    "u4_union_all_table_stats": "q14_data_availability",
    "s7_currency_label": "a1_sum_revenue",
    "s18_case_label": "q6_search_facets",
    "s19_build_json_object": "u1_union_all_events",
}
for _alias, _target in ALIASES.items():
    QUERIES[_alias] = QUERIES[_target]


# ---------------------------------------------------------------- ST1 / ST2 streaming
def land_export(rows, folder, parts=1):
    """Land an export in parts that each hold rows of every day; the tasks that make a part's rows write its files, at least one. Returns the number of files."""
    from pyspark.sql import functions as F
    from sessionscope.session import children
    part = F.pmod(F.xxhash64("event_timestamp", "user_pseudo_id"), F.lit(parts))
    for number in range(parts):
        (rows if parts == 1 else rows.filter(part == number)).write.mode("append").parquet(folder)
    return sum(name.endswith(".parquet") for name, _, _ in children(rows.sparkSession, folder))


@register("st1_incremental_reingest", fixture_sql("""
SELECT 'purchase' AS event_table, tenant_id, strftime(event_date, '%Y-%m-%d') AS event_date, event_timestamp,
       param_ga_session_id, user_prop_webuserid FROM purchase
UNION ALL SELECT 'add_to_cart', tenant_id, strftime(event_date, '%Y-%m-%d'), event_timestamp, param_ga_session_id,
       user_prop_webuserid FROM add_to_cart
UNION ALL SELECT 'page_view', tenant_id, strftime(event_date, '%Y-%m-%d'), event_timestamp, param_ga_session_id,
       user_prop_webuserid FROM page_view
UNION ALL SELECT 'view_search_results', tenant_id, strftime(event_date, '%Y-%m-%d'), event_timestamp, param_ga_session_id,
       user_prop_webuserid FROM view_search_results
UNION ALL SELECT 'no_search_results', tenant_id, strftime(event_date, '%Y-%m-%d'), event_timestamp, param_ga_session_id,
       user_prop_webuserid FROM no_search_results
UNION ALL SELECT 'view_item', tenant_id, strftime(event_date, '%Y-%m-%d'), event_timestamp, param_ga_session_id,
       user_prop_webuserid FROM view_item"""))
def st1_incremental_reingest(spark, sf_dir):
    """Five exports over all days of the data land in turn: the first half of the days; the second half split over files
    and triggers; a half-empty export of two days far apart and of one other day; and, in one landing with an
    export of that day again, the complete export of the two days. The tables end equal to the source."""
    import datetime as dt
    import os
    import uuid
    from functools import reduce
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F
    from sessionscope.session import scratch_dir
    from sessionscope.sources.extract import EVENT_NAMES
    from sessionscope.sources.fixtures import base_events, read_source
    from sessionscope.sources.raw import raw_events
    from sessionscope.streaming.reingest import incremental_reingest
    t = tables(spark, sf_dir)
    # the source may be in order of time: its rows are dealt out before they are nested, so that every landing keeps all tasks busy
    base = base_events(read_source(spark, sf_dir, "events").repartition("event_id"), read_source(spark, sf_dir, "customer"))
    raw = raw_events(base)
    root = scratch_dir(spark, f"st1-{uuid.uuid4().hex}", temporary=True)
    landing, wh, ckpt = (os.path.join(root, x) for x in ("landing", "warehouse", "checkpoint"))
    lo, hi = t.base.agg(F.min("event_date"), F.max("event_date")).first()    # every event has a row in the export
    day = lambda share: (lo + dt.timedelta(days=int((hi - lo).days * share))).strftime("%Y%m%d")
    on = F.col("event_date")
    two, other = on.isin(day(0.1), day(0.9)), on == day(0.5)
    stale = F.col("event_timestamp") % 2 == 0

    def catch_up(**kw):
        incremental_reingest(spark, landing, wh, ckpt, raw_schema=raw.schema, **kw).awaitTermination()

    land_export(raw.filter(on <= day(0.5)), f"{landing}/export_id=1")
    catch_up()
    files = land_export(raw.filter(on > day(0.5)), f"{landing}/export_id=2", parts=2)
    catch_up(max_files_per_trigger=(files + 1) // 2)
    land_export(raw.filter((two | other) & stale), f"{landing}/export_id=3")
    catch_up()
    land_export(raw.filter(other), f"{landing}/export_id=4")
    land_export(raw.filter(two), f"{landing}/export_id=5", parts=2)
    catch_up()
    parts = [spark.read.parquet(os.path.join(wh, name)).select(
        F.lit(name).alias("event_table"), "tenant_id", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
        "event_timestamp", "param_ga_session_id", "user_prop_webuserid") for name in EVENT_NAMES]
    return reduce(DataFrame.unionByName, parts)


def followed_tables(spark, sf_dir, names):
    """Event tables loaded through I14 and followed by ST2 streams. First the stale tables arrive (the purchases doubled, the
    early half of the days without its second tenant), and the streams take them in; then a replace of the whole range brings the real
    rows, one of a day brings a half and a last one the day again, and one empties a stray day that no source has."""
    import os
    import uuid
    from functools import partial
    from pyspark.sql import functions as F
    from sessionscope.session import scratch_dir, side_by_side
    from sessionscope.sources.sinks import replace_date_range
    from sessionscope.streaming.rollups import CHART_TABLES, follow, read_rollup
    t = tables(spark, sf_dir)
    root = scratch_dir(spark, f"st2-{uuid.uuid4().hex}", temporary=True)
    path = lambda kind, name: os.path.join(root, kind, name)
    on = F.col("event_date")
    lo, hi = t.page_view.agg(F.min("event_date"), F.max("event_date")).first()
    middle = lo + (hi - lo) / 2

    def catch_up():
        for query in [follow(spark, path("tables", name), getattr(t, name).schema, path("rollups", name), path("checkpoints", name), CHART_TABLES[name]) for name in names]:
            query.awaitTermination()

    def replace(name, start, end, rows):
        replace_date_range(spark, path("tables", name), None, start.isoformat(), end.isoformat(), rows)

    def on_all(step):
        for error in side_by_side(spark, {name: partial(step, name) for name in names}).values():
            raise error
        catch_up()

    def stale_tables(name):
        rows = getattr(t, name)
        stale = rows.filter((on > middle) | (F.col("tenant_id") == "T0"))
        stale = stale.union(stale) if name == "purchase" else stale
        replace(name, lo, stray, stale.union(stale.filter(on == middle).withColumn("event_date", F.lit(stray))))

    def real_rows_but_half_a_day(name):
        rows = getattr(t, name)
        replace(name, lo, stray, rows)
        replace(name, middle, middle, rows.filter((on == middle) & (F.col("event_id") % 2 == 0)))

    import datetime as dt
    stray = hi + dt.timedelta(days=40)
    on_all(stale_tables)
    on_all(real_rows_but_half_a_day)
    on_all(lambda name: replace(name, middle, middle, getattr(t, name).filter(on == middle)))
    return {name: read_rollup(spark, path("rollups", name)) for name in names}


@register("st2_tumbling_buckets", fixture_sql(f"""
SELECT tenant_id, strftime({_duck_bucket('make_timestamp(CAST(event_timestamp AS BIGINT))', '4hours')[0]},
                           '%Y-%m-%d %H:%M:%S') AS window_start, COUNT(*) AS events
FROM page_view WHERE regexp_matches(event_timestamp, '^[0-9]+$') GROUP BY 1, 2"""))
def st2_tumbling_buckets(spark, sf_dir):
    """Page views in windows of four hours, kept up by the stream over replaced, halved and emptied days."""
    from pyspark.sql import functions as F
    from sessionscope.functions.timebucket import bucket_start
    views = followed_tables(spark, sf_dir, ["page_view"])["page_view"]
    start = F.date_format(bucket_start(F.col("hour_start"), "4hours"), "yyyy-MM-dd HH:mm:ss")
    return views.filter("hour_start is not null").groupBy("tenant_id", start.alias("window_start")).agg(F.sum("events").cast("bigint").alias("events"))


@register("st2_chart_of_replaced_days", "\nUNION ALL ".join(f"SELECT '{g}' AS granularity, * FROM ({q2_sql(g)}) q_{g}" for g in (
    "hourly", "4hours", "12hours", "daily", "weekly", "monthly")))
def st2_chart_of_replaced_days(spark, sf_dir):
    """Q2 in all six granularities from the contributions of the followed tables; equal to Q2 over the tables."""
    from functools import reduce
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F
    from sessionscope.functions.timebucket import GRANULARITIES
    from sessionscope.streaming.rollups import CHART_TABLES, rolled_chart
    rollups = followed_tables(spark, sf_dir, list(CHART_TABLES))
    return reduce(DataFrame.unionByName, [rolled_chart(rollups, START, END, g).withColumn("granularity", F.lit(g)) for g in GRANULARITIES])


# ---------------------------------------------------------------- F1 function surface
@register("f1_table_function_surface", "SELECT * FROM (" + q4_sql(1, 50) + ") x WHERE tenant_id = 'T0'")
def f1_table_function_surface(spark, sf_dir):
    """The named function with its reference defaults, called through the surface."""
    from sessionscope.functions.surface import call
    return call(tables(spark, sf_dir), "get_purchase_tasks", "T0", 1, 50)["data"]


@register("f1_sql_table_function", "SELECT * FROM (" + q2_sql("weekly") + ") x WHERE tenant_id = 'T0'")
def f1_sql_table_function(spark, sf_dir):
    """A named function called as an SQL table function."""
    from sessionscope.functions.sqlsurface import register_functions
    register_functions(tables(spark, sf_dir))
    return spark.sql(f"SELECT * FROM get_chart_data('T0', '{START}', '{END}', 'weekly')")


@register("f1_sql_views_overview", Q1_SQL)
def f1_sql_views_overview(spark, sf_dir):
    """The registered views answer the overview through ``spark.sql`` as well."""
    from sessionscope.functions.surface import register_views
    register_views(tables(spark, sf_dir), prefix="ss_")
    rng = f"event_date BETWEEN DATE'{START}' AND DATE'{END}'"
    return spark.sql(f"""
    WITH figures AS (
      SELECT tenant_id, 'revenue' AS what, CAST(SUM(ecommerce_purchase_revenue) AS DECIMAL(38,2)) AS v FROM ss_purchase WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'purchases', COUNT(*) FROM ss_purchase WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'visitors', COUNT(DISTINCT param_ga_session_id) FROM ss_page_view WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'users', COUNT(DISTINCT user_prop_webuserid) FROM ss_page_view WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'abandoned', COUNT(DISTINCT param_ga_session_id) FROM ss_add_to_cart c
        LEFT ANTI JOIN ss_purchase p USING (tenant_id, param_ga_session_id) WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'searches', COUNT(*) FROM ss_view_search_results WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'failed', COUNT(*) FROM ss_no_search_results WHERE {rng} GROUP BY 1
      UNION ALL SELECT tenant_id, 'repeat', COUNT_IF(lo < hi) FROM (
        SELECT tenant_id, MIN(param_ga_session_id) AS lo, MAX(param_ga_session_id) AS hi FROM ss_page_view
        WHERE {rng} AND user_prop_webuserid IS NOT NULL GROUP BY tenant_id, user_prop_webuserid) GROUP BY 1)
    SELECT tenant_id, COALESCE(CONCAT('$', CAST(revenue AS STRING)), '$0') AS total_revenue,
           CAST(COALESCE(purchases, 0) AS BIGINT) AS purchases, CAST(COALESCE(visitors, 0) AS BIGINT) AS total_visitors,
           CAST(COALESCE(users, 0) AS BIGINT) AS unique_users, CAST(COALESCE(abandoned, 0) AS BIGINT) AS abandoned_carts,
           CAST(COALESCE(searches, 0) AS BIGINT) AS total_searches, CAST(COALESCE(failed, 0) AS BIGINT) AS failed_searches,
           CAST(COALESCE(repeat, 0) AS BIGINT) AS repeat_visits,
           CAST(COALESCE(ROUND(COALESCE(purchases, 0) / NULLIF(visitors, 0) * 100, 2), 0) AS DOUBLE) AS conversion_rate
    FROM figures PIVOT (MAX(v) FOR what IN ('revenue', 'purchases', 'visitors', 'users', 'abandoned', 'searches', 'failed', 'repeat'))""")


# Page first (20 per tenant), then enrich only the page with viewed products.
register("j8_enrich_page_with_products", q7_sql(20))(_q("repeat_visit_tasks", page=1, limit=20))

# Parameter variants that the keys above leave out.
register("l2_deep_page", q4_sql(2, 1000))(_q("purchase_tasks", page=2, limit=1000))
PAGE_DEPTHS = ((0, 20), (150, 25), (333, 10))


@register("l2_pages_by_ranges", fixture_sql(f"""
SELECT tenant_id, row_num, event_id, event_timestamp FROM (
  SELECT tenant_id, event_id, event_timestamp, row_number() OVER (PARTITION BY tenant_id ORDER BY param_page_title ASC NULLS LAST, event_timestamp DESC, event_id) AS row_num
  FROM page_view) x WHERE {' OR '.join(f'(row_num > {o} AND row_num <= {o + n})' for o, n in PAGE_DEPTHS)}"""))
def l2_pages_by_ranges(spark, sf_dir):
    """Three pages of every tenant's page views at once, located by the counts of sampled ranges."""
    from pyspark.sql import functions as F
    from sessionscope.operators.paging import select_pages
    views = tables(spark, sf_dir).page_view.select("tenant_id", "event_id", "event_timestamp", "param_page_title")
    order = [F.col("param_page_title").asc_nulls_last(), F.col("event_timestamp").desc(), F.col("event_id").asc()]
    return select_pages(views, order, PAGE_DEPTHS).select("tenant_id", "row_num", "event_id", "event_timestamp")


_SKETCH_RANGES = {"all": (START, END), "half": ("2024-01-08", "2024-01-21"), "day": ("2024-01-05", "2024-01-05")}


@register("a3_sketched_distinct", fixture_sql("\nUNION ALL ".join(f"""
SELECT tenant_id, '{name}' AS period, COUNT(DISTINCT param_ga_session_id) AS exact_visitors, COUNT(DISTINCT user_prop_webuserid) AS exact_users, true AS within_bound
FROM page_view WHERE event_date BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY tenant_id""" for name, (lo, hi) in _SKETCH_RANGES.items())))
def a3_sketched_distinct(spark, sf_dir):
    """Estimates of three periods from one table of daily sketches, measured against the exact counts."""
    import uuid
    from functools import reduce
    from pyspark.sql import DataFrame
    from pyspark.sql import functions as F
    from sessionscope.operators.filters import scope
    from sessionscope.plans.sketches import ERROR_BOUND, approximate_visitors, daily_sketches
    from sessionscope.session import scratch_dir
    t = tables(spark, sf_dir)
    path = scratch_dir(spark, f"a3-{uuid.uuid4().hex}", temporary=True)
    daily_sketches(t).write.parquet(path)
    sketches = spark.read.parquet(path)
    near = lambda estimate, exact: F.abs(F.col(estimate) - F.col(exact)) <= F.lit(ERROR_BOUND) * F.col(exact) + 1

    def period(name, start, end):
        exact = scope(t.page_view, None, None, start, end).groupBy("tenant_id").agg(
            F.count_distinct("param_ga_session_id").alias("exact_visitors"), F.count_distinct("user_prop_webuserid").alias("exact_users"))
        both = exact.join(F.broadcast(approximate_visitors(sketches, start, end)), "tenant_id")    # one row a tenant
        return both.select("tenant_id", F.lit(name).alias("period"), "exact_visitors", "exact_users",
                           (near("total_visitors", "exact_visitors") & near("unique_users", "exact_users")).alias("within_bound"))
    return reduce(DataFrame.unionByName, [period(name, *rng) for name, rng in _SKETCH_RANGES.items()])


register("q6_include_converted", q6_sql(join=""))(_q("search_analysis_tasks", include_converted=True))
register("q6_search_type", f"SELECT *  REPLACE (COUNT(*) OVER (PARTITION BY tenant_id) AS total_count) FROM ({q6_sql()}) x WHERE search_type = 'no_results'")(
    _q("search_analysis_tasks", search_type="no_results"))
