"""Timelines: U1 (six event tables as one event stream), Q11 user history and
Q12 session history. Details are JSON text built JVM-side with ``to_json``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.kv import to_json_keep_nulls
from sessionscope.operators.filters import tenant_filter
from sessionscope.operators.sessions import SESSION
from sessionscope.sources.fixtures import Tables


def _details(t: Tables) -> list[tuple[str, DataFrame, Column]]:
    return [
        ("page_view", t.page_view, F.struct(F.col("param_page_location").alias("page_location"),
                                            F.col("param_page_title").alias("page_title"))),
        ("add_to_cart", t.add_to_cart, F.struct(F.col("first_item_item_id").alias("item_id"),
                                                F.col("first_item_item_name").alias("item_name"),
                                                F.col("first_item_price").alias("price"),
                                                F.col("first_item_quantity").alias("quantity"))),
        ("purchase", t.purchase, F.struct(F.col("param_transaction_id").alias("transaction_id"),
                                          F.col("ecommerce_purchase_revenue").alias("revenue"),
                                          F.coalesce(F.col("items_json"), F.lit("[]")).alias("items"))),
        ("view_search_results", t.view_search_results, F.struct(F.col("param_search_term").alias("search_term"))),
        ("no_search_results", t.no_search_results,
         F.struct(F.col("param_no_search_results_term").alias("search_term"))),
        ("view_item", t.view_item, F.struct(F.col("first_item_item_id").alias("item_id"),
                                            F.col("first_item_item_name").alias("item_name"),
                                            F.col("first_item_price").alias("price"),
                                            F.col("first_item_item_category").alias("category"))),
    ]


def all_events(t: Tables, tenant_id: str | None = None, session_id: str | None = None) -> DataFrame:
    """(tenant_id, event_timestamp, session, event_type, details JSON) over the six tables."""
    parts = []
    for name, df, details in _details(t):
        d = tenant_filter(df, tenant_id)
        if session_id is not None:
            d = d.filter(F.col(SESSION) == F.lit(session_id))
        parts.append(d.select("tenant_id", "event_timestamp", SESSION, F.lit(name).alias("event_type"),
                              to_json_keep_nulls(details).alias("details")))
    return reduce(DataFrame.unionByName, parts)


def user_history(t: Tables, user_id: str | None = None, tenant_id: str | None = None, ordered: bool = True) -> DataFrame:
    """Q11: every event of every session in which the user has a page view (other
    users' events in those sessions included). ``user_id=None``: all users at once. ``ordered=False`` leaves the
    order (L6) to a caller that ranks the rows itself, as R15 does."""
    pv = tenant_filter(t.page_view, tenant_id).filter(F.col(SESSION).isNotNull())
    if user_id is not None:
        pv = pv.filter(F.col("user_prop_webuserid") == F.lit(user_id))
    else:
        pv = pv.filter(F.col("user_prop_webuserid").isNotNull())
    user_sessions = pv.select("tenant_id", F.col("user_prop_webuserid").alias("user_id"), SESSION).distinct()
    ev = all_events(t, tenant_id)
    tl = ev.join(user_sessions, ["tenant_id", SESSION], "inner")            # J3 per user
    rows = tl.select("tenant_id", "user_id", "event_timestamp", F.col(SESSION).alias("session_id"), "event_type", "details")
    return rows.orderBy("tenant_id", "user_id", "event_timestamp", "event_type", "details") if ordered else rows   # L6


def session_history(t: Tables, session_id: str | None = None, tenant_id: str | None = None) -> DataFrame:
    """Q12: the timeline of one session (``None``: every session, keyed by session)."""
    ev = all_events(t, tenant_id, session_id).filter(F.col(SESSION).isNotNull())
    return (ev.select("tenant_id", F.col(SESSION).alias("session_id"), "event_timestamp", "event_type", "details")
            .orderBy("tenant_id", "session_id", "event_timestamp", "event_type", "details"))
