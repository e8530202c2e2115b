"""F1 in SQL: the 15 named functions as temporary table functions of a session, with the reference's parameters and defaults.

``register_functions(tables)`` makes ``SELECT * FROM get_purchase_tasks('T0', 1, 50)`` work in ``spark.sql``, with named arguments
(``p_sort_field => 'order_value'``). Spark puts the arguments in place of the parameters before it optimises, so a tenant or a date
range becomes a partition filter, an unused parameter's condition vanishes, and a page's row number becomes a top-k.
A function returns the data rows of the Python call of the same name; totals come with every row of a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.functions.surface import register_views
from sessionscope.functions.timebucket import SPINE_STEP_HOURS, SUB_DAY
from sessionscope.operators.identity import users_by_key
from sessionscope.plans.history import all_events
from sessionscope.sources.fixtures import Tables

#: Prefix of the views that the functions read.
PREFIX = "ss_"
_SID = "param_ga_session_id"
_USER_OUT = "user_id STRING, customer_name STRING, email STRING, phone STRING, office_phone STRING"
_USER_COLUMNS = "u.user_id, u.customer_name, u.email, u.phone, u.office_phone"
_RANGE = "p_location_id STRING DEFAULT NULL, p_start_date STRING DEFAULT NULL, p_end_date STRING DEFAULT NULL"


def _scope(alias: str, location: bool = True) -> str:
    """Rows of the tenant, and of the branch and the days where they are given."""
    place = f" AND (p_location_id IS NULL OR {alias}.user_prop_default_branch_id = p_location_id)" if location else ""
    return (f"{alias}.tenant_id = p_tenant_id{place} AND (p_start_date IS NULL OR {alias}.event_date >= CAST(p_start_date AS DATE))"
            f" AND (p_end_date IS NULL OR {alias}.event_date <= CAST(p_end_date AS DATE))")


def _customers(alias: str) -> str:
    """Join of a row's customers: by its user id, else by its customer number."""
    key = f"CASE WHEN {alias}.user_prop_webuserid IS NOT NULL THEN concat('U:', {alias}.user_prop_webuserid) ELSE concat('E:', {alias}.user_prop_webcustomerid) END"
    return f"LEFT JOIN (SELECT * FROM {PREFIX}users_by_key WHERE _u_tenant = p_tenant_id) u ON u._u_key = {key}"


def _day(micros: str) -> str:
    return f"date_format(timestamp_micros(try_cast({micros} AS BIGINT)), 'yyyy-MM-dd')"


def _like(*columns: str) -> str:
    return "(p_query IS NULL OR " + " OR ".join(f"coalesce({c} ILIKE concat('%', p_query, '%'), false)" for c in columns) + ")"


def _order(sorts: dict[str, str], fallback: str, ties: list[str]) -> str:
    """L1 as one ORDER BY: each sortable field counts only if it was asked for."""
    asked = [f"CASE WHEN p_sort_field = '{name}' AND p_sort_order = '{way}' THEN {column} END {way} NULLS LAST" for name, column in sorts.items() for way in ("asc", "desc")]
    return ", ".join([*asked, f"{fallback} DESC NULLS FIRST", *[f"{t} ASC NULLS FIRST" for t in ties]])


def _page(rows: str, order: str, columns: str, totals: str = "SELECT count(*) AS total_count FROM listed") -> str:
    """A page of ``rows`` with the total of all of them; ``columns`` are chosen from alias ``r``."""
    return f"""
WITH listed AS ({rows}),
placed AS (SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS row_num FROM listed)
SELECT {columns}, c.total_count, r.row_num FROM placed r CROSS JOIN ({totals}) c
WHERE r.row_num > (p_page - 1) * p_limit AND r.row_num <= p_page * p_limit"""


def _window(rows: str, order: str, columns: str) -> str:
    """The same by limit and offset."""
    return _page(rows, order, columns).replace("(p_page - 1) * p_limit", "p_offset").replace("p_page * p_limit", "p_offset + p_limit")


def _no_purchase(alias: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM {PREFIX}with_purchase s WHERE s.tenant_id = {alias}.tenant_id AND s.{_SID} = {alias}.{_SID})"


def _items(fields: list[str], row: str) -> str:
    """Canonical text of an item: its fields, empty where there is none."""
    return "concat_ws('|', " + ", ".join(f"coalesce(CAST({row}.{f} AS STRING), '')" for f in fields) + ")"


def _bounced() -> str:
    return f"""SELECT {_SID}, user_prop_webuserid, max(user_prop_webcustomerid) AS user_prop_webcustomerid, max(event_timestamp) AS last_activity,
  min_by(param_page_location, struct(event_timestamp, event_id)) AS entry_page
FROM {PREFIX}page_view v WHERE {_scope('v')} GROUP BY {_SID}, user_prop_webuserid HAVING count(DISTINCT param_page_location) = 1"""


def _bucket(at: str) -> str:
    return f"""CASE p_granularity WHEN 'monthly' THEN date_trunc('month', {at}) WHEN 'weekly' THEN date_trunc('week', {at})
  WHEN 'hourly' THEN date_trunc('hour', {at}) WHEN '4hours' THEN date_trunc('hour', {at}) - make_dt_interval(0, hour({at}) % 4)
  WHEN '12hours' THEN date_trunc('hour', {at}) - make_dt_interval(0, hour({at}) % 12) ELSE date_trunc('day', {at}) END"""


def _sub_day() -> str:
    return "p_granularity IN (" + ", ".join(f"'{g}'" for g in SUB_DAY) + ")"


def _chart() -> str:
    at = f"CASE WHEN {_sub_day()} THEN timestamp_micros(try_cast(e.event_timestamp AS BIGINT)) ELSE CAST(e.event_date AS TIMESTAMP) END"
    counted = lambda kind, table, revenue="NULL", more="": (
        f"SELECT '{kind}' AS kind, {at} AS moment, e.{_SID} AS sid, CAST({revenue} AS DECIMAL(38,2)) AS revenue FROM {PREFIX}{table} e"
        f" WHERE {_scope('e')} AND p_start_date IS NOT NULL AND p_end_date IS NOT NULL AND (NOT {_sub_day()} OR e.event_timestamp RLIKE '^[0-9]+$') {more}")
    step = " ".join(f"WHEN '{g}' THEN {hours}" for g, hours in SPINE_STEP_HOURS.items())
    return f"""
WITH points AS (
  SELECT explode(sequence(to_timestamp(concat(p_start_date, ' 00:00:00')), to_timestamp(concat(p_end_date, ' 23:59:59')),
    make_dt_interval(0, CASE p_granularity {step} ELSE 24 END))) AS point),
spine AS (SELECT DISTINCT {_bucket('point')} AS bucket FROM points),
counted AS (
  {counted('purchase', 'purchase', 'e.ecommerce_purchase_revenue')} UNION ALL {counted('view', 'page_view')}
  UNION ALL {counted('cart', 'add_to_cart', more='AND ' + _no_purchase('e'))}
  UNION ALL {counted('search', 'view_search_results')} UNION ALL {counted('search', 'no_search_results')}),
figures AS (
  SELECT {_bucket('moment')} AS bucket, sum(revenue) AS revenue, count_if(kind = 'purchase') AS purchases, count(DISTINCT CASE WHEN kind = 'view' THEN sid END) AS visitors,
    count(DISTINCT CASE WHEN kind = 'cart' THEN sid END) AS carts, count_if(kind = 'search') AS searches
  FROM counted GROUP BY 1)
SELECT p_tenant_id, CASE WHEN p_granularity = 'monthly' THEN date_format(s.bucket, 'yyyy-MM-01')
    WHEN p_granularity = 'weekly' THEN concat(CAST(extract(YEAROFWEEK FROM s.bucket) AS STRING), '-', lpad(CAST(weekofyear(s.bucket) AS STRING), 2, '0'))
    WHEN {_sub_day()} THEN date_format(s.bucket, 'yyyy-MM-dd HH:00') ELSE date_format(s.bucket, 'yyyy-MM-dd') END,
  date_format(s.bucket, 'yyyy-MM-dd HH:mm:ss'), CAST(round(coalesce(f.revenue, 0), 2) AS DOUBLE), coalesce(f.purchases, 0), coalesce(f.visitors, 0), coalesce(f.carts, 0), coalesce(f.searches, 0)
FROM spine s LEFT JOIN figures f ON f.bucket = s.bucket"""


def _overview() -> str:
    given = "p_start_date IS NOT NULL AND p_end_date IS NOT NULL"
    n = lambda what, table, value, more="": f"SELECT '{what}' AS what, CAST({value} AS DECIMAL(38,2)) AS v FROM {PREFIX}{table} e WHERE {_scope('e')} AND {given} {more}"
    repeat = (f"SELECT 'repeat' AS what, CAST(count(*) AS DECIMAL(38,2)) AS v FROM (SELECT 1 FROM {PREFIX}page_view e WHERE {_scope('e')} AND {given} AND e.user_prop_webuserid IS NOT NULL"
              f" GROUP BY e.user_prop_webuserid HAVING min(e.{_SID}) < max(e.{_SID}))")
    figures = [n("revenue", "purchase", "sum(e.ecommerce_purchase_revenue)"), n("purchases", "purchase", "count(*)"), n("visitors", "page_view", f"count(DISTINCT e.{_SID})"),
               n("users", "page_view", "count(DISTINCT e.user_prop_webuserid)"), n("abandoned", "add_to_cart", f"count(DISTINCT e.{_SID})", "AND " + _no_purchase("e")),
               n("searches", "view_search_results", "count(*)"), n("failed", "no_search_results", "count(*)"), repeat]
    of = lambda what: f"CAST(coalesce(max(CASE WHEN what = '{what}' THEN v END), 0) AS BIGINT)"
    money = "max(CASE WHEN what = 'revenue' THEN v END)"
    return f"""
SELECT p_tenant_id, a.* FROM (
  SELECT CASE WHEN {money} IS NULL THEN '$0' ELSE concat('$', CAST({money} AS STRING)) END AS revenue, {of('purchases')} AS purchases, {of('visitors')} AS visitors, {of('users')} AS users,
    {of('abandoned')} AS abandoned, {of('searches')} AS searches, {of('failed')} AS failed, {of('repeat')} AS repeats,
    CAST(CASE WHEN {of('visitors')} > 0 THEN round(CAST({of('purchases')} AS DECIMAL(38,10)) / {of('visitors')} * 100, 2) ELSE 0 END AS DOUBLE) AS conversion
  FROM ({' UNION ALL '.join(figures)})) a"""


def _location_stats() -> str:
    part = lambda table: f"{PREFIX}{table} e WHERE {_scope('e', location=False)} AND p_start_date IS NOT NULL AND p_end_date IS NOT NULL"
    branch = "e.user_prop_default_branch_id AS branch"
    columns = {"revenue": "DECIMAL(38,2)", "purchases": "BIGINT", "visitors": "BIGINT", "abandoned": "BIGINT", "repeats": "BIGINT", "failed": "BIGINT"}
    row = lambda **given: ", ".join(f"CAST({given.get(c, 'NULL')} AS {kind}) AS {c}" for c, kind in columns.items())
    return f"""
WITH figures AS (
  SELECT branch, {row(visitors='sum(n)', repeats='count_if(viewer IS NOT NULL AND n > 1)')} FROM (
    SELECT {branch}, e.user_prop_webuserid AS viewer, count(DISTINCT e.{_SID}) AS n FROM {part('page_view')} GROUP BY 1, 2) GROUP BY branch
  UNION ALL SELECT {branch}, {row(revenue='sum(e.ecommerce_purchase_revenue)', purchases='count(*)')} FROM {part('purchase')} GROUP BY 1
  UNION ALL SELECT {branch}, {row(abandoned=f'count(DISTINCT e.{_SID})')} FROM {part('add_to_cart')} AND {_no_purchase('e')} GROUP BY 1
  UNION ALL SELECT {branch}, {row(failed='count(*)')} FROM {part('no_search_results')} GROUP BY 1),
folded AS (SELECT branch, {', '.join(f'max({c}) AS {c}' for c in columns)} FROM figures WHERE branch IS NOT NULL GROUP BY branch)
SELECT l.tenant_id, l.warehouse_code, l.warehouse_name, l.city, l.state, CASE WHEN f.revenue IS NULL THEN '$0' ELSE concat('$', CAST(f.revenue AS STRING)) END,
  coalesce(f.purchases, 0), coalesce(f.visitors, 0), coalesce(f.abandoned, 0), coalesce(f.repeats, 0), coalesce(f.failed, 0)
FROM {PREFIX}locations l LEFT JOIN folded f ON f.branch = l.warehouse_code
WHERE l.tenant_id = p_tenant_id AND l.is_active AND p_start_date IS NOT NULL AND p_end_date IS NOT NULL"""


def _purchase_tasks() -> str:
    rows = f"SELECT e.*, {_USER_COLUMNS} FROM {PREFIX}purchase e {_customers('e')} WHERE {_scope('e')} AND {_like('e.items_json')}"
    order = _order({"event_timestamp": "event_timestamp", "order_value": "ecommerce_purchase_revenue", "customer_name": "customer_name"}, "event_timestamp", ["event_id", "user_id"])
    return _page(rows, order, f"r.tenant_id, r.param_transaction_id, {_day('r.event_timestamp')}, CAST(round(coalesce(r.ecommerce_purchase_revenue, 0), 2) AS DOUBLE), "
                 f"coalesce(r.param_page_location, ''), r.{_SID}, r.user_id, r.customer_name, r.email, r.phone, r.office_phone, coalesce(r.items_json, '[]'), false")


def _cart_tasks() -> str:
    fields = [f"first_item_{f}" for f in ("item_id", "item_name", "item_category", "price", "quantity")]
    rows = f"""
  SELECT d.*, {_USER_COLUMNS} FROM (
    SELECT i.{_SID}, i.user_prop_webuserid, max(i.erp) AS user_prop_webcustomerid, max(i.latest) AS last_activity, sum(i.n) AS items_count, sum(i.worth) AS total_value,
      array_join(array_sort(collect_list(concat(i.item, 'x', CAST(i.times AS STRING)))), ';') AS products
    FROM (
      SELECT c.{_SID}, c.user_prop_webuserid, {_items(fields, 'c')} AS item, max(c.user_prop_webcustomerid) AS erp, max(c.event_timestamp) AS latest, count(c.event_id) AS n,
        sum(c.first_item_price * c.first_item_quantity) AS worth, count(*) AS times
      FROM {PREFIX}add_to_cart c JOIN (
        SELECT DISTINCT e.{_SID} FROM {PREFIX}add_to_cart e {_customers('e')} WHERE {_scope('e')} AND {_no_purchase('e')} AND {_like('u.customer_name', 'u.email', 'e.first_item_item_name')}) a
        ON a.{_SID} = c.{_SID} WHERE c.tenant_id = p_tenant_id
      GROUP BY c.{_SID}, c.user_prop_webuserid, {', '.join('c.' + f for f in fields)}) i
    GROUP BY i.{_SID}, i.user_prop_webuserid) d {_customers('d')}"""
    order = _order({c: c for c in ("total_value", "last_activity", "customer_name", "items_count")}, "last_activity", [_SID, "user_prop_webuserid", "user_id"])
    return _page(rows, order, f"p_tenant_id, r.{_SID}, {_day('r.last_activity')}, {_day('r.last_activity')}, r.items_count, CAST(round(r.total_value, 2) AS DOUBLE), "
                 "r.user_id, r.customer_name, r.email, r.phone, r.office_phone, r.products")


def _search_tasks() -> str:
    rows = f"""
  SELECT d.*, {_USER_COLUMNS} FROM (
    SELECT e.{_SID}, e.user_prop_webuserid, max(e.user_prop_webcustomerid) AS user_prop_webcustomerid, e.param_no_search_results_term AS search_term, 'no_results' AS search_type,
      count(*) AS search_count, max(e.event_timestamp) AS last_activity
    FROM {PREFIX}no_search_results e WHERE {_scope('e')} AND {_like('e.param_no_search_results_term')} GROUP BY e.{_SID}, e.user_prop_webuserid, e.param_no_search_results_term
    UNION ALL
    SELECT e.{_SID}, e.user_prop_webuserid, max(e.user_prop_webcustomerid), nullif(array_join(array_sort(collect_set(e.param_search_term)), ', '), ''), 'no_conversion',
      count(*), max(e.event_timestamp)
    FROM {PREFIX}view_search_results e WHERE {_scope('e')} AND {_like('e.param_search_term')} AND (p_include_converted OR {_no_purchase('e')})
    GROUP BY e.{_SID}, e.user_prop_webuserid HAVING count(*) > 2) d {_customers('d')}
  WHERE p_search_type IS NULL OR d.search_type = p_search_type"""
    order = _order({"search_count": "search_count", "search_term": "search_term"}, "last_activity", [_SID, "user_prop_webuserid", "search_type", "search_term", "user_id"])
    return _page(rows, order, f"p_tenant_id, r.{_SID}, {_day('r.last_activity')}, r.search_term, r.search_type, r.search_count, r.user_id, r.customer_name, r.email, r.phone, r.office_phone")


def _repeat_tasks() -> str:
    rows = f"""
  SELECT d.*, {_USER_COLUMNS} FROM (
    SELECT *, count({_SID}) OVER (PARTITION BY user_prop_webuserid) AS sessions FROM (
      SELECT e.{_SID}, e.user_prop_webuserid, max(e.user_prop_webcustomerid) AS user_prop_webcustomerid, count(DISTINCT e.param_page_location) AS page_views_count,
        max(e.event_timestamp) AS last_activity
      FROM {PREFIX}page_view e WHERE {_scope('e')} AND e.user_prop_webuserid IS NOT NULL GROUP BY e.{_SID}, e.user_prop_webuserid HAVING count(DISTINCT e.param_page_location) > 2)) d {_customers('d')}
  WHERE d.sessions > 1 AND {_like('u.customer_name', 'u.email')}"""
    order = _order({c: c for c in ("page_views_count", "last_activity")}, "last_activity", [_SID, "user_prop_webuserid", "user_id"])
    product = _items(["title", "url", "category", "price"], "s")
    page = _page(rows, order, "r.*")
    return f"""
SELECT p_tenant_id, g.{_SID}, {_day('g.last_activity')}, g.page_views_count, coalesce(v.n, 0), coalesce(v.details, ''), g.user_id, g.customer_name, g.email, g.phone, g.office_phone,
  g.total_count, g.row_num
FROM ({page.replace('SELECT r.*, c.total_count, r.row_num', 'SELECT r.*, c.total_count')}) g LEFT JOIN (
  SELECT {_SID}, count(DISTINCT first_item_item_id) AS n, array_join(array_sort(transform(collect_set(struct(coalesce(first_item_item_name, first_item_item_id) AS title,
    param_page_location AS url, first_item_item_category AS category, first_item_price AS price)), s -> concat({product}, 'x1'))), ';') AS details
  FROM {PREFIX}view_item WHERE tenant_id = p_tenant_id AND first_item_item_id IS NOT NULL AND {_SID} IS NOT NULL GROUP BY {_SID}) v ON v.{_SID} = g.{_SID}"""


def _performance_tasks() -> str:
    rows = f"SELECT b.*, {_USER_COLUMNS} FROM ({_bounced()}) b {_customers('b')}"
    order = _order({c: c for c in ("last_activity", "customer_name", "entry_page")}, "last_activity", [_SID, "user_prop_webuserid", "user_id"])
    return _page(rows, order, f"p_tenant_id, r.{_SID}, {_day('r.last_activity')}, r.entry_page, r.user_id, r.customer_name, r.email, r.phone, r.office_phone",
                 f"SELECT count(*) AS total_count FROM ({_bounced()})")


def _stamp(column: str) -> str:
    return f"date_format(r.{column}, 'yyyy-MM-dd HH:mm:ss')"


def _functions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, columns, body)."""
    paged = "p_tenant_id STRING, p_page INT, p_limit INT, p_query STRING DEFAULT NULL, " + _RANGE
    sorted_by = lambda field: f", p_sort_field STRING DEFAULT '{field}', p_sort_order STRING DEFAULT 'desc'"
    dated = "p_tenant_id STRING, p_start_date STRING, p_end_date STRING"
    sliced = "p_tenant_id STRING, p_limit INT DEFAULT 50, p_offset INT DEFAULT 0"
    end = "total_count BIGINT, row_num BIGINT"
    events = f"FROM {PREFIX}timeline e WHERE e.tenant_id = p_tenant_id AND"
    days = " UNION ALL ".join(f"SELECT event_date FROM {PREFIX}{t} WHERE tenant_id = p_tenant_id" for t in (
        "purchase", "add_to_cart", "page_view", "view_search_results", "no_search_results", "view_item"))
    newest = "created_at DESC NULLS LAST, job_id ASC"
    return {
        "get_dashboard_overview_stats": (dated + ", p_location_id STRING DEFAULT NULL",
            "tenant_id STRING, total_revenue STRING, purchases BIGINT, total_visitors BIGINT, unique_users BIGINT, abandoned_carts BIGINT, total_searches BIGINT, failed_searches BIGINT, "
            "repeat_visits BIGINT, conversion_rate DOUBLE", _overview()),
        "get_chart_data": (dated + ", p_granularity STRING, p_location_id STRING DEFAULT NULL",
            "tenant_id STRING, date_group STRING, period_start STRING, revenue DOUBLE, purchases BIGINT, visitors BIGINT, carts BIGINT, searches BIGINT", _chart()),
        "get_location_stats_bulk": (dated, "tenant_id STRING, location_id STRING, location_name STRING, city STRING, state STRING, total_revenue STRING, purchases BIGINT, "
            "total_visitors BIGINT, abandoned_carts BIGINT, repeat_visits BIGINT, failed_searches BIGINT", _location_stats()),
        "get_purchase_tasks": (paged + sorted_by("event_timestamp"), f"tenant_id STRING, transaction_id STRING, event_date STRING, order_value DOUBLE, page_location STRING, "
            f"ga_session_id STRING, {_USER_OUT}, products STRING, completed BOOLEAN, {end}", _purchase_tasks()),
        "get_cart_abandonment_tasks": (paged + sorted_by("last_activity"), f"tenant_id STRING, session_id STRING, event_date STRING, last_activity STRING, items_count BIGINT, "
            f"total_value DOUBLE, {_USER_OUT}, products STRING, {end}", _cart_tasks()),
        "get_search_analysis_tasks": (paged + ", p_include_converted BOOLEAN DEFAULT false" + sorted_by("search_count") + ", p_search_type STRING DEFAULT NULL",
            f"tenant_id STRING, session_id STRING, event_date STRING, search_term STRING, search_type STRING, search_count BIGINT, {_USER_OUT}, {end}", _search_tasks()),
        "get_repeat_visit_tasks": (paged + sorted_by("page_views_count"), f"tenant_id STRING, session_id STRING, event_date STRING, page_views_count BIGINT, products_viewed BIGINT, "
            f"products_details STRING, {_USER_OUT}, {end}", _repeat_tasks()),
        "get_performance_tasks": ("p_tenant_id STRING, p_page INT, p_limit INT, " + _RANGE + sorted_by("last_activity"),
            f"tenant_id STRING, session_id STRING, event_date STRING, entry_page STRING, {_USER_OUT}, {end}", _performance_tasks()),
        "get_user_history": ("p_tenant_id STRING, p_user_id STRING", "tenant_id STRING, user_id STRING, event_timestamp STRING, session_id STRING, event_type STRING, details STRING",
            f"SELECT e.tenant_id, p_user_id, e.event_timestamp, e.{_SID}, e.event_type, e.details FROM {PREFIX}timeline e JOIN (SELECT DISTINCT {_SID} FROM {PREFIX}page_view"
            f" WHERE tenant_id = p_tenant_id AND user_prop_webuserid = p_user_id) v ON v.{_SID} = e.{_SID} WHERE e.tenant_id = p_tenant_id"),
        "get_session_history": ("p_tenant_id STRING, p_session_id STRING", "tenant_id STRING, event_timestamp STRING, event_type STRING, details STRING",
            f"SELECT e.tenant_id, e.event_timestamp, e.event_type, e.details {events} e.{_SID} = p_session_id"),
        "get_locations": ("p_tenant_id STRING", "tenant_id STRING, location_id STRING, location_name STRING, city STRING, state STRING",
            f"SELECT tenant_id, warehouse_code, warehouse_name, city, state FROM {PREFIX}locations WHERE tenant_id = p_tenant_id AND is_active"),
        "get_data_availability_combined": ("p_tenant_id STRING", "tenant_id STRING, event_count BIGINT, earliest_date STRING, latest_date STRING",
            f"SELECT p_tenant_id, a.* FROM (SELECT count(*) AS n, date_format(min(event_date), 'yyyy-MM-dd') AS first, date_format(max(event_date), 'yyyy-MM-dd') AS last FROM ({days})) a"),
        "get_tenant_jobs_paginated": (sliced, "id STRING, tenant_id STRING, job_id STRING, status STRING, data_types STRING, start_date STRING, end_date STRING, progress STRING, "
            f"records_processed STRING, error_message STRING, created_at STRING, started_at STRING, completed_at STRING, {end}",
            _window(f"SELECT * FROM {PREFIX}processing_jobs WHERE tenant_id = p_tenant_id", newest, "r.id, r.tenant_id, r.job_id, r.status, r.data_types, "
                    f"date_format(r.start_date, 'yyyy-MM-dd'), date_format(r.end_date, 'yyyy-MM-dd'), r.progress, r.records_processed, r.error_message, {_stamp('created_at')}, {_stamp('started_at')}, {_stamp('completed_at')}")),
        "get_email_jobs_paginated": (sliced + ", p_status STRING DEFAULT NULL", "tenant_id STRING, job_id STRING, status STRING, report_date STRING, target_branches STRING, total_emails INT, "
            f"emails_sent INT, emails_failed INT, error_message STRING, created_at STRING, started_at STRING, completed_at STRING, has_more BOOLEAN, {end}",
            _window(f"SELECT * FROM {PREFIX}email_sending_jobs WHERE tenant_id = p_tenant_id AND (p_status IS NULL OR status = p_status)", newest,
                    "r.tenant_id, r.job_id, r.status, date_format(r.report_date, 'yyyy-MM-dd'), array_join(r.target_branches, ','), r.total_emails, r.emails_sent, r.emails_failed, r.error_message, "
                    f"{_stamp('created_at')}, {_stamp('started_at')}, {_stamp('completed_at')}, p_offset + p_limit < c.total_count")),
        "get_email_send_history_paginated": (sliced + ", p_branch_code STRING DEFAULT NULL, p_status STRING DEFAULT NULL, p_start_date STRING DEFAULT NULL, p_end_date STRING DEFAULT NULL",
            f"tenant_id STRING, id STRING, job_id STRING, branch_code STRING, sales_rep_email STRING, sales_rep_name STRING, subject STRING, report_date STRING, status STRING, "
            f"smtp_response STRING, error_message STRING, sent_at STRING, {end}",
            _window(f"SELECT * FROM {PREFIX}email_send_history WHERE tenant_id = p_tenant_id AND (p_branch_code IS NULL OR branch_code = p_branch_code) AND (p_status IS NULL OR status = p_status)"
                    " AND (p_start_date IS NULL OR report_date >= CAST(p_start_date AS DATE)) AND (p_end_date IS NULL OR report_date <= CAST(p_end_date AS DATE))", "sent_at DESC NULLS LAST, id ASC",
                    f"r.tenant_id, r.id, r.job_id, r.branch_code, r.sales_rep_email, r.sales_rep_name, r.subject, date_format(r.report_date, 'yyyy-MM-dd'), r.status, r.smtp_response, r.error_message, {_stamp('sent_at')}")),
    }


def register_functions(t: Tables) -> list[str]:
    """Register the views and the functions in the tables' session; returns the functions' names."""
    spark: SparkSession = t.purchase.sparkSession
    register_views(t, PREFIX)
    views: dict[str, DataFrame] = {"users_by_key": users_by_key(t.users), "timeline": all_events(t),
                                   "with_purchase": t.with_purchase().select("tenant_id", _SID).where(F.col(_SID).isNotNull())}
    for name, view in views.items():
        view.createOrReplaceTempView(PREFIX + name)
    functions = _functions()
    for name, (parameters, columns, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body}")
    return list(functions)
