"""Skew guards for equi-joins.

NULL join keys never match, but a plain hash shuffle still sends every NULL-key
row to one reducer. ``spread_null_key`` gives such rows distinct, deterministic,
never-matching keys so they spread evenly; hot non-NULL keys are split at
runtime by AQE's skew-join handling (enabled in ``session.REQUIRED_CONF``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NULL_TAG = "\u0000null:"


def spread_null_key(key: Column, *salt: Column) -> Column:
    return F.coalesce(key, F.concat(F.lit(_NULL_TAG), F.xxhash64(*salt).cast("string")))
