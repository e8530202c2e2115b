"""Predicates P1-P12. Optional parameters follow the reference: ``None`` = no filter,
date bounds inclusive. Only the predicates that are needed are added to the
plan, so each reaches the parquet scan as a pushed filter."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRANCH = "user_prop_default_branch_id"


def tenant_filter(df: DataFrame, tenant_id: str | None) -> DataFrame:
    """Equality on tenant; ``None`` keeps every tenant (results are then per tenant)."""
    return df if tenant_id is None else df.filter(F.col("tenant_id") == F.lit(tenant_id))


def location_filter(df: DataFrame, location_id: str | None, col: str = BRANCH) -> DataFrame:
    """``loc IS NULL OR branch = loc``."""
    return df if location_id is None else df.filter(F.col(col) == F.lit(location_id))


def date_range_filter(df: DataFrame, start: str | None, end: str | None,
                      col: str = "event_date") -> DataFrame:
    """P3 (each bound optional) / P4 (both given): inclusive bounds on a DATE column."""
    if start is not None:
        df = df.filter(F.col(col) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.filter(F.col(col) <= F.to_date(F.lit(end)))
    return df


def scope(df: DataFrame, tenant_id: str | None = None, location_id: str | None = None,
          start: str | None = None, end: str | None = None) -> DataFrame:
    """P1 + P2 + P3 together -- the standard event-table scope of every query."""
    return date_range_filter(location_filter(tenant_filter(df, tenant_id), location_id), start, end)


def ilike_contains(c: Column, q: str) -> Column:
    """P5: ``c ILIKE '%' || q || '%'``; ``%``/``_`` inside ``q`` stay wildcards."""
    return c.ilike(f"%{q}%")


def any_ilike(cols: Iterable[Column], q: str) -> Column:
    """OR of ILIKE over several columns; a NULL column does not match."""
    out = None
    for c in cols:
        m = F.coalesce(ilike_contains(c, q), F.lit(False))
        out = m if out is None else (out | m)
    return out if out is not None else F.lit(False)


def digits_only(c: Column) -> Column:
    """``c ~ '^[0-9]+$'`` (NULL -> false)."""
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def optional_eq(df: DataFrame, col: str, value) -> DataFrame:
    """P10: optional equality (status, branch code ...)."""
    return df if value is None else df.filter(F.col(col) == F.lit(value))


def status_in_and_older(df: DataFrame, statuses: Iterable[str], as_of: str, minutes: int = 15,
                        status_col: str = "status", ts_col: str = "updated_at") -> DataFrame:
    """Status in a set and ``updated_at < as_of - minutes``."""
    cutoff = F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return df.filter(F.col(status_col).isin(list(statuses)) & (F.col(ts_col) < cutoff))
