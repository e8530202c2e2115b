"""A3 in its opt-in approximate form: distinct sessions and users from mergeable sketches.

One HyperLogLog sketch a (tenant, branch, day) is kept for the sessions and one for the users of the page views. Sketches merge, so
any date range of any set of branches is answered from them alone, without the events. Exact counts stay the default everywhere
else (``count_distinct``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.filters import scope
from sessionscope.operators.sessions import SESSION
from sessionscope.sources.fixtures import Tables

#: Base-2 logarithm of a sketch's registers: 4,096, a relative standard error of 1.6 %.
REGISTERS_LOG2 = 12
#: Four standard errors: what an estimate may differ by.
ERROR_BOUND = 0.065
BRANCH = "user_prop_default_branch_id"


def daily_sketches(t: Tables) -> DataFrame:
    """(tenant, branch, day) with a sketch of the sessions and one of the users; NULLs are not counted."""
    return t.page_view.groupBy("tenant_id", BRANCH, "event_date").agg(
        F.hll_sketch_agg(SESSION, REGISTERS_LOG2).alias("sessions"), F.hll_sketch_agg("user_prop_webuserid", REGISTERS_LOG2).alias("users"))


def approximate_visitors(sketches: DataFrame, start: str | None = None, end: str | None = None, tenant_id: str | None = None,
                         location_id: str | None = None, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Estimated distinct sessions and users of a range, by tenant (or the ``by`` columns), from ``daily_sketches``."""
    rows = scope(sketches, tenant_id, location_id, start, end)
    merged = rows.groupBy(*by).agg(F.hll_union_agg("sessions").alias("sessions"), F.hll_union_agg("users").alias("users"))
    return merged.select(*by, F.hll_sketch_estimate("sessions").alias("total_visitors"), F.hll_sketch_estimate("users").alias("unique_users"))
