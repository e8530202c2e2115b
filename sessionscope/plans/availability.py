"""Q14 data availability: total events, earliest and latest date over the six
event tables -- aggregated per table first, then the six partial rows combined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.operators.filters import tenant_filter
from sessionscope.sources.fixtures import Tables


def table_stats(t: Tables, tenant_id: str | None = None) -> DataFrame:
    """U4: one (tenant, table) row of count/min/max per event table."""
    parts = [tenant_filter(df, tenant_id).groupBy("tenant_id").agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("cnt"),
        F.min("event_date").alias("min_date"),
        F.max("event_date").alias("max_date")) for name, df in t.events().items()]
    return reduce(DataFrame.unionByName, parts)


def data_availability(t: Tables, tenant_id: str | None = None) -> DataFrame:
    """Q14 (A5): two-level min/max and summed counts."""
    s = table_stats(t, tenant_id)
    if tenant_id is not None:
        s = s.unionByName(t.purchase.sparkSession.range(1).select(
            F.lit(tenant_id).alias("tenant_id"), F.lit(None).cast("string").alias("table_name"),
            F.lit(0).cast("bigint").alias("cnt"), F.lit(None).cast("date").alias("min_date"),
            F.lit(None).cast("date").alias("max_date")))
    return s.groupBy("tenant_id").agg(
        F.sum("cnt").cast("bigint").alias("event_count"),
        F.date_format(F.min("min_date"), "yyyy-MM-dd").alias("earliest_date"),
        F.date_format(F.max("max_date"), "yyyy-MM-dd").alias("latest_date"))
