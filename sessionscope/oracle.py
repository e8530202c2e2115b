"""DuckDB oracle SQL: the fixture rules and every query, written independently
of the Spark code in the reference's own SQL shape (CTEs, OR-join to users,
NOT EXISTS, COUNT(*) OVER ()). ``fixture_sql(body)`` prefixes a query body
with the table derivations so it runs on the driver's pre-registered views.
"""

from __future__ import annotations

# FIXTURES.md rules as DuckDB CTEs. Output conventions shared with Spark:
# money -> CAST(round(x, 2) AS DOUBLE), dates -> 'YYYY-MM-DD' text,
# timestamps -> 'YYYY-MM-DD HH:MM:SS' text, counts -> BIGINT.
FIXTURE_CTES = r"""
base0 AS (
  SELECT e.event_id,
         'T' || CAST(e.user_id % 2 AS VARCHAR) AS tenant_id,
         CAST(e.ts AS DATE) AS event_date,
         CAST(epoch_us(e.ts) AS VARCHAR) AS event_timestamp,
         'px' || CAST(e.user_id AS VARCHAR) AS user_pseudo_id,
         CASE WHEN e.user_id % 10 <> 0 THEN CAST(e.user_id AS VARCHAR) END AS user_prop_webuserid,
         'ERP' || CAST(e.user_id // 4 AS VARCHAR) AS user_prop_webcustomerid,
         'D' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') AS user_prop_default_branch_id,
         CAST(e.user_id * 1000 + date_diff('day', DATE '2024-01-01', CAST(e.ts AS DATE)) // 3 AS VARCHAR) AS param_ga_session_id,
         CAST(json_extract(e.props, '$.k') AS INTEGER) AS k,
         e.event_type, e.value
  FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id
),
base AS (
  SELECT *,
    CASE WHEN k % 4 = 0 THEN '/product/P' || CAST(k AS VARCHAR) ELSE '/page/' || CAST(k % 20 AS VARCHAR) END AS param_page_location,
    CASE WHEN event_type = 'error' THEN (CASE WHEN k % 3 = 0 THEN 'No Results Found' ELSE 'Search' END)
         ELSE 'Page ' || CAST(k % 20 AS VARCHAR) END AS param_page_title,
    CASE WHEN k % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device_category,
    CASE k % 3 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' ELSE 'Windows' END AS device_operating_system,
    'US' AS geo_country,
    'City ' || CAST(k % 7 AS VARCHAR) AS geo_city,
    '[{"item_id":"P' || CAST(k AS VARCHAR) || '","item_name":"Item ' || CAST(k % 10 AS VARCHAR)
      || '","price":' || CAST(k + 1 AS VARCHAR) || ',"quantity":' || CAST(k % 5 + 1 AS VARCHAR) || '}]' AS items_json
  FROM base0
),
purchase AS (
  SELECT *, 'TX' || CAST(event_id AS VARCHAR) AS param_transaction_id,
         CAST(CAST(value AS DECIMAL(15,2)) * 5 AS DECIMAL(15,2)) AS ecommerce_purchase_revenue
  FROM base WHERE event_type = 'purchase'
),
add_to_cart AS (
  SELECT *, 'P' || CAST(k AS VARCHAR) AS first_item_item_id,
         'Item ' || CAST(k % 10 AS VARCHAR) AS first_item_item_name,
         'Cat ' || CAST(k % 5 AS VARCHAR) AS first_item_item_category,
         CAST(value AS DECIMAL(10,2)) AS first_item_price,
         CAST(k % 5 + 1 AS INTEGER) AS first_item_quantity
  FROM base WHERE event_type = 'click'
),
page_view AS (
  SELECT *, '/page/' || CAST(k % 5 AS VARCHAR) AS param_page_referrer
  FROM base WHERE event_type IN ('view', 'signup')
),
view_item AS (
  SELECT *, 'P' || CAST(k AS VARCHAR) AS first_item_item_id,
         'Item ' || CAST(k % 10 AS VARCHAR) AS first_item_item_name,
         'Cat ' || CAST(k % 5 AS VARCHAR) AS first_item_item_category,
         CAST(value AS DECIMAL(10,2)) AS first_item_price
  FROM base WHERE event_type = 'signup'
),
no_search_results AS (
  SELECT *, 'term ' || CAST(k % 15 AS VARCHAR) AS param_no_search_results_term
  FROM base WHERE event_type = 'error' AND k % 3 = 0
),
view_search_results AS (
  SELECT *, 'term ' || CAST(k % 15 AS VARCHAR) AS param_search_term
  FROM base WHERE event_type = 'error' AND k % 3 <> 0
),
users AS (
  SELECT 'T' || CAST(c_custkey % 2 AS VARCHAR) AS tenant_id,
         CAST(c_custkey AS VARCHAR) AS user_id,
         c_name AS user_name,
         'Company ' || CAST(c_custkey % 40 AS VARCHAR) AS buying_company_name,
         'ERP' || CAST(c_custkey // 4 AS VARCHAR) AS buying_company_erp_id,
         'u' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email,
         '+1-555-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS office_phone,
         CASE WHEN c_custkey % 5 <> 0 THEN '+1-777-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS cell_phone,
         true AS is_active
  FROM customer WHERE c_custkey % 7 <> 3
),
locations AS (
  SELECT t.tenant_id,
         CAST(n.n_nationkey AS VARCHAR) AS warehouse_id,
         'D' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS warehouse_code,
         n.n_name AS warehouse_name,
         'City ' || CAST(n.n_nationkey AS VARCHAR) AS city,
         r.r_name AS state,
         (n.n_nationkey % 7 <> 0) AS is_active
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  CROSS JOIN (VALUES ('T0'), ('T1')) t(tenant_id)
),
branch_email_mappings AS (
  SELECT 'T' || CAST(s_suppkey % 2 AS VARCHAR) AS tenant_id,
         'D' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS branch_code,
         'Branch ' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS branch_name,
         'rep' || CAST(s_suppkey AS VARCHAR) || '@example.org' AS sales_rep_email,
         s_name AS sales_rep_name,
         (s_suppkey % 4 <> 0) AS is_enabled
  FROM supplier
),
processing_jobs AS (
  SELECT 'job_' || CAST(o_orderkey AS VARCHAR) AS id,
         'T' || CAST(o_custkey % 2 AS VARCHAR) AS tenant_id,
         'job_' || CAST(o_orderkey AS VARCHAR) AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
         '["events"]' AS data_types,
         CAST(o_orderdate AS DATE) - 2 AS start_date,
         CAST(o_orderdate AS DATE) AS end_date,
         '{"current":"events","retrigger_count":' || CAST(o_orderkey % 5 AS VARCHAR) || '}' AS progress,
         '{"purchase":' || CAST(o_orderkey % 50 AS VARCHAR) || ',"page_view":' || CAST(o_orderkey % 900 AS VARCHAR) || '}' AS records_processed,
         CAST(NULL AS VARCHAR) AS error_message,
         o_orderdate AS created_at,
         o_orderdate + INTERVAL 60 SECOND AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 7200) END AS completed_at,
         o_orderdate AS updated_at
  FROM orders
),
email_sending_jobs AS (
  SELECT 'T' || CAST(o_custkey % 2 AS VARCHAR) AS tenant_id,
         'email_' || CAST(o_orderkey AS VARCHAR) AS job_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status,
         CAST(o_orderdate AS DATE) AS report_date,
         ['D' || lpad(CAST(o_custkey % 25 AS VARCHAR), 2, '0')] AS target_branches,
         CAST(o_orderkey % 5 + 1 AS INTEGER) AS total_emails,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 5 + 1 AS INTEGER) ELSE 0 END AS emails_sent,
         0 AS emails_failed,
         CAST(NULL AS VARCHAR) AS error_message,
         o_orderdate AS created_at,
         o_orderdate AS updated_at,
         o_orderdate + INTERVAL 60 SECOND AS started_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 7200) END AS completed_at
  FROM orders
),
email_send_history AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
         'T' || CAST(l_orderkey % 2 AS VARCHAR) AS tenant_id,
         'email_' || CAST(l_orderkey AS VARCHAR) AS job_id,
         'D' || lpad(CAST(l_suppkey % 25 AS VARCHAR), 2, '0') AS branch_code,
         'rep' || CAST(l_suppkey AS VARCHAR) || '@example.org' AS sales_rep_email,
         'Rep ' || CAST(l_suppkey AS VARCHAR) AS sales_rep_name,
         'Daily Branch Sales Report - ' || strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') || ' - '
           || 'D' || lpad(CAST(l_suppkey % 25 AS VARCHAR), 2, '0') AS subject,
         CAST(l_shipdate AS DATE) AS report_date,
         CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'sent' END AS status,
         CASE WHEN l_returnflag <> 'R' THEN '250 OK' END AS smtp_response,
         CASE WHEN l_returnflag = 'R' THEN 'mailbox unavailable' END AS error_message,
         l_shipdate AS sent_at
  FROM lineitem
)
"""


# Users under both keys by which an event can name them.
CONTACTS_CTE = """contacts AS (
  SELECT *, 'id ' || user_id AS contact FROM users
  UNION ALL SELECT *, 'erp ' || buying_company_erp_id FROM users
)"""


def fixture_sql(body: str, extra_ctes: str = "") -> str:
    """``WITH <fixture CTEs>[, extra] <body>``; ``body`` starts with SELECT."""
    ctes = FIXTURE_CTES.strip() + ",\n" + CONTACTS_CTE
    if extra_ctes.strip():
        ctes += ",\n" + extra_ctes.strip()
    return f"WITH {ctes}\n{body.strip()}"
