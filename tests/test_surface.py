"""every named function, called for one tenant, agrees with the all-tenant query behind it."""

import pytest
from pyspark.sql import functions as F

from sessionscope.functions.surface import FUNCTIONS, call
from sessionscope.plans import availability, chart, history, jobs, locations, overview, worklists
from sessionscope.registry import END, START
from sessionscope.sources.fixtures import load_tables

SF = "/root/testdata/sf0.001"
PAGE = (2, 10)


def rows(df):
    return sorted(str(sorted(r.asDict(recursive=True).items())) for r in df.collect())


def paged(fn):
    return lambda t: fn(t, page=PAGE[0], limit=PAGE[1])


def first_user(t):
    return t.page_view.filter("tenant_id = 'T0' and user_prop_webuserid is not null").agg(F.min("user_prop_webuserid")).first()[0]


def first_session(t):
    return t.page_view.filter("tenant_id = 'T0' and param_ga_session_id is not null").agg(F.min("param_ga_session_id")).first()[0]


CASES = {
    "get_dashboard_overview_stats": ((START, END), lambda t: overview.overview_stats(t, START, END)),
    "get_chart_data": ((START, END, "weekly"), lambda t: chart.chart_data(t, START, END, "weekly")),
    "get_location_stats_bulk": ((START, END), lambda t: locations.location_stats(t, START, END)),
    "get_purchase_tasks": (PAGE, paged(worklists.purchase_tasks)),
    "get_cart_abandonment_tasks": (PAGE, paged(worklists.cart_abandonment_tasks)),
    "get_search_analysis_tasks": (PAGE, paged(worklists.search_analysis_tasks)),
    "get_repeat_visit_tasks": (PAGE, paged(worklists.repeat_visit_tasks)),
    "get_performance_tasks": (PAGE, paged(worklists.performance_bounced_sessions)),
    "get_locations": ((), locations.locations_list),
    "get_data_availability_combined": ((), availability.data_availability),
    "get_tenant_jobs_paginated": ((7, 3), lambda t: jobs.ingestion_jobs_page(t, limit=7, offset=3)),
    "get_email_jobs_paginated": ((7, 3, "completed"), lambda t: jobs.email_jobs_page(t, limit=7, offset=3, status="completed")),
    "get_email_send_history_paginated": ((7, 3), lambda t: jobs.email_history_page(t, limit=7, offset=3)),
}


def test_every_function_is_covered():
    assert set(CASES) | {"get_user_history", "get_session_history"} == set(FUNCTIONS) and len(FUNCTIONS) == 15


@pytest.mark.parametrize("name", sorted(CASES))
def test_function_agrees_with_all_tenants(spark, name):
    t = load_tables(spark, SF)
    args, everyone = CASES[name]
    got = call(t, name, "T0", *args)
    if isinstance(got, dict):
        assert got["envelope"].first()["page"] == PAGE[0] and set(got) >= {"data", "envelope"}
        got = got["data"]
    assert rows(got) == rows(everyone(t).filter("tenant_id = 'T0'")) != []


def test_history_functions(spark):
    t = load_tables(spark, SF)
    user, session = first_user(t), first_session(t)
    assert rows(call(t, "get_user_history", "T0", user)) == rows(history.user_history(t).filter(F.col("user_id") == user).filter("tenant_id = 'T0'")) != []
    assert rows(call(t, "get_session_history", "T0", session)) == rows(
        history.session_history(t, None, "T0").filter(F.col("session_id") == session).drop("session_id")) != []


def literal(x):
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


@pytest.fixture(scope="module")
def sql(spark):
    from sessionscope.functions.sqlsurface import register_functions
    t = load_tables(spark, SF)
    assert set(register_functions(t)) == set(FUNCTIONS)

    def ask(name, *args, **named):
        given = [literal(a) for a in args] + [f"p_{k} => {literal(v)}" for k, v in named.items()]
        return spark.sql(f"SELECT * FROM {name}('T0'{''.join(', ' + g for g in given)})")
    return t, ask


@pytest.mark.parametrize("name", sorted(CASES))
def test_sql_function_equals_the_python_call(sql, name):
    t, ask = sql
    args, _ = CASES[name]
    want, got = call(t, name, "T0", *args), ask(name, *args)
    want = want["data"] if isinstance(want, dict) else want
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) != []


VARIANTS = [
    ("get_purchase_tasks", (1, 5), {"query": "item 7", "location_id": "D05", "sort_field": "order_value", "sort_order": "asc"}),
    ("get_purchase_tasks", (1, 30), {"start_date": "2024-01-05", "end_date": "2024-01-20", "sort_field": "customer_name", "sort_order": "desc"}),
    ("get_cart_abandonment_tasks", (1, 500), {"query": "company 1", "sort_field": "total_value", "sort_order": "desc"}),
    ("get_cart_abandonment_tasks", (1, 20), {"start_date": "2024-01-10", "sort_field": "nonsense"}),
    ("get_search_analysis_tasks", (1, 50), {"include_converted": True, "search_type": "no_conversion"}),
    ("get_search_analysis_tasks", (2, 20), {"query": "term 1", "sort_field": "search_term", "sort_order": "asc"}),
    ("get_repeat_visit_tasks", (1, 50), {"query": "company 2", "sort_field": "last_activity", "sort_order": "asc"}),
    ("get_performance_tasks", (1, 40), {"location_id": "D07", "sort_field": "entry_page", "sort_order": "asc"}),
    ("get_dashboard_overview_stats", (START, END), {"location_id": "D03"}),
    ("get_dashboard_overview_stats", (None, END), {}),
    *[("get_chart_data", (START, END, g), {}) for g in ("hourly", "4hours", "12hours", "daily", "monthly", "no such")],
    ("get_email_send_history_paginated", (), {"branch_code": "D03", "status": "failed", "start_date": "1995-01-01"}),
    ("get_tenant_jobs_paginated", (), {}),
]


@pytest.mark.parametrize(("name", "args", "named"), VARIANTS)
def test_sql_function_with_parameters(sql, name, args, named):
    t, ask = sql
    asked = {k: ("true" if v is True else v) for k, v in named.items()}
    got = ask(name, *args, **asked)
    want = call(t, name, "T0", *args, **named)
    want = want["data"] if isinstance(want, dict) else want
    assert rows(got) == rows(want)


def test_sql_histories_and_pruning(sql):
    t, ask = sql
    user, session = first_user(t), first_session(t)
    assert rows(ask("get_user_history", user)) == rows(call(t, "get_user_history", "T0", user)) != []
    assert rows(ask("get_session_history", session)) == rows(call(t, "get_session_history", "T0", session)) != []
    plan = ask("get_purchase_tasks", 1, 5, start_date="2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "CartesianProduct" not in plan
