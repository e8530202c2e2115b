"""Session-keyed set operators: J2 (no purchase in the session, NOT EXISTS) and
J3 (session IN subquery), keyed by (tenant_id, param_ga_session_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.skew import spread_null_key

SESSION = "param_ga_session_id"


def distinct_sessions(df: DataFrame) -> DataFrame:
    """(tenant_id, session) pairs; pre-aggregated map-side before any shuffle."""
    return df.select("tenant_id", SESSION).filter(F.col(SESSION).isNotNull()).distinct()


def without_purchase(df: DataFrame, purchase: DataFrame, salt: list[str] | None = None) -> DataFrame:
    """Rows whose session has no purchase at any time (NULL sessions are kept,
    exactly like ``NOT EXISTS``)."""
    right = distinct_sessions(purchase).withColumnRenamed(SESSION, "_s_key")
    salt_cols = [F.col(c) for c in (salt or df.columns)]
    left = df.withColumn("_s_key", spread_null_key(F.col(SESSION), *salt_cols))
    return left.join(right, ["tenant_id", "_s_key"], "left_anti").drop("_s_key")


def in_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows whose (tenant, session) is in ``sessions`` (NULL never matches)."""
    right = distinct_sessions(sessions)
    return df.filter(F.col(SESSION).isNotNull()).join(right, ["tenant_id", SESSION], "left_semi")
