"""the named, parameterised analytic functions with the reference's defaults.

``call(tables, "get_purchase_tasks", tenant_id, page=1, limit=50)`` returns the
DataFrame(s) the reference function describes; ``register_views`` exposes the
tables as temporary views so the same data can be queried with ``spark.sql``.
Paged worklists return ``{"data": rows, "envelope": total/page/limit/has_more}``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.paging import page_envelope
from sessionscope.plans import availability, chart, history, jobs, locations, overview, worklists
from sessionscope.sources.fixtures import Tables


def _paged(rows: DataFrame, page: int, limit: int) -> dict[str, DataFrame]:
    totals = rows.groupBy("tenant_id").agg(F.max("total_count").alias("total_count"))
    return {"data": rows, "envelope": page_envelope(totals, page, limit)}


def get_dashboard_overview_stats(t: Tables, tenant_id, start_date, end_date, location_id=None):
    return overview.overview_stats(t, start_date, end_date, tenant_id, location_id)


def get_chart_data(t: Tables, tenant_id, start_date, end_date, granularity, location_id=None):
    return chart.chart_data(t, start_date, end_date, granularity, tenant_id, location_id)


def get_location_stats_bulk(t: Tables, tenant_id, start_date, end_date):
    return locations.location_stats(t, start_date, end_date, tenant_id)


def get_purchase_tasks(t: Tables, tenant_id, page, limit, query=None, location_id=None, start_date=None,
                       end_date=None, sort_field="event_timestamp", sort_order="desc"):
    return _paged(worklists.purchase_tasks(t, tenant_id, page, limit, query, location_id, start_date, end_date,
                                           sort_field, sort_order), page, limit)


def get_cart_abandonment_tasks(t: Tables, tenant_id, page, limit, query=None, location_id=None, start_date=None,
                               end_date=None, sort_field="last_activity", sort_order="desc"):
    return _paged(worklists.cart_abandonment_tasks(t, tenant_id, page, limit, query, location_id, start_date,
                                                   end_date, sort_field, sort_order), page, limit)


def get_search_analysis_tasks(t: Tables, tenant_id, page, limit, query=None, location_id=None, start_date=None,
                              end_date=None, include_converted=False, sort_field="search_count",
                              sort_order="desc", search_type=None):
    rows = worklists.search_analysis_tasks(t, tenant_id, page, limit, query, location_id, start_date, end_date,
                                           include_converted, sort_field, sort_order, search_type)
    out = _paged(rows, page, limit)
    out["facets"] = worklists.search_facets(t, tenant_id, query, location_id, start_date, end_date,
                                            include_converted)
    return out


def get_repeat_visit_tasks(t: Tables, tenant_id, page, limit, query=None, location_id=None, start_date=None,
                           end_date=None, sort_field="page_views_count", sort_order="desc"):
    return _paged(worklists.repeat_visit_tasks(t, tenant_id, page, limit, query, location_id, start_date,
                                               end_date, sort_field, sort_order), page, limit)


def get_performance_tasks(t: Tables, tenant_id, page, limit, location_id=None, start_date=None, end_date=None,
                          sort_field="last_activity", sort_order="desc", issue_type=None):
    out = {}
    if issue_type in (None, "high_bounce"):
        out.update(_paged(worklists.performance_bounced_sessions(
            t, tenant_id, page, limit, location_id, start_date, end_date, sort_field, sort_order), page, limit))
    if issue_type in (None, "page_bounce_issue"):
        out["frequently_bounced_pages"] = worklists.frequently_bounced_pages(t, tenant_id, location_id,
                                                                             start_date, end_date)
    out["facets"] = worklists.performance_facets(t, tenant_id, location_id, start_date, end_date)
    return out


def get_user_history(t: Tables, tenant_id, user_id):
    return history.user_history(t, user_id, tenant_id)


def get_session_history(t: Tables, tenant_id, session_id):
    return history.session_history(t, session_id, tenant_id).drop("session_id")


def get_locations(t: Tables, tenant_id):
    return locations.locations_list(t, tenant_id)


def get_data_availability_combined(t: Tables, tenant_id):
    return availability.data_availability(t, tenant_id)


def get_tenant_jobs_paginated(t: Tables, tenant_id, limit=50, offset=0):
    return jobs.ingestion_jobs_page(t, tenant_id, limit, offset)


def get_email_jobs_paginated(t: Tables, tenant_id, limit=50, offset=0, status=None):
    return jobs.email_jobs_page(t, tenant_id, limit, offset, status)


def get_email_send_history_paginated(t: Tables, tenant_id, limit=50, offset=0, branch_code=None, status=None,
                                     start_date=None, end_date=None):
    return jobs.email_history_page(t, tenant_id, limit, offset, branch_code, status, start_date, end_date)


FUNCTIONS = {f.__name__: f for f in (
    get_dashboard_overview_stats, get_chart_data, get_location_stats_bulk, get_purchase_tasks,
    get_cart_abandonment_tasks, get_search_analysis_tasks, get_repeat_visit_tasks, get_performance_tasks,
    get_user_history, get_session_history, get_locations, get_data_availability_combined,
    get_tenant_jobs_paginated, get_email_jobs_paginated, get_email_send_history_paginated)}


def call(t: Tables, name: str, *args, **kwargs):
    """Invoke a named analytic function (unknown names raise KeyError)."""
    return FUNCTIONS[name](t, *args, **kwargs)


def register_views(t: Tables, prefix: str = "") -> list[str]:
    """Expose every table as a temporary view for ``spark.sql``."""
    names = []
    for name in ("purchase", "add_to_cart", "page_view", "view_search_results", "no_search_results", "view_item",
                 "users", "locations", "branch_email_mappings", "processing_jobs", "email_sending_jobs",
                 "email_send_history"):
        df = getattr(t, name)
        if df is not None:
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
    return names
