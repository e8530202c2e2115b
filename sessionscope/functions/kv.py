"""Nested event helpers (S10-S13): key/value parameter lookup, first item, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _kv_value(arr: Column, key: str) -> Column:
    # First entry whose key matches; NULL when absent (no row explosion).
    return F.get(F.filter(arr, lambda kv: kv["key"] == F.lit(key)), 0)["value"]


def kv_int_first(arr: Column, key: str) -> Column:
    """Integer value as text first, else the string value (ids)."""
    v = _kv_value(arr, key)
    return F.coalesce(v["int_value"].cast("string"), v["string_value"])


def kv_string_first(arr: Column, key: str) -> Column:
    """String value first, else the integer value as text."""
    v = _kv_value(arr, key)
    return F.coalesce(v["string_value"], v["int_value"].cast("string"))


def first_item(items: Column, field: str) -> Column:
    """``items[SAFE_OFFSET(0)].field`` -- NULL for a NULL or empty array."""
    return F.get(items, 0)[field]


def to_json_keep_nulls(c: Column) -> Column:
    """JSON text of arrays/structs that keeps NULL fields."""
    return F.to_json(c, {"ignoreNullFields": "false"})
