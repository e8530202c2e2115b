"""Time helpers (S1-S6): epoch-micro text, bucket starts, labels and the spine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("hourly", "4hours", "12hours", "daily", "weekly", "monthly")
SUB_DAY = ("hourly", "4hours", "12hours")
# Spine step per granularity (the reference generates points, then buckets them).
SPINE_STEP_HOURS = {"hourly": 1, "4hours": 4, "12hours": 12, "daily": 24, "weekly": 24, "monthly": 24}


def normalize_granularity(g: str | None) -> str:
    """Unknown granularities fall back to daily."""
    return g if g in GRANULARITIES else "daily"


def micros_to_ts(micros_text: Column) -> Column:
    """Epoch-microsecond text -> timestamp; non-numeric text gives NULL."""
    return F.timestamp_micros(micros_text.try_cast("bigint"))


def micros_to_date_text(micros_text: Column) -> Column:
    """``TO_CHAR(TO_TIMESTAMP(us / 1e6), 'YYYY-MM-DD')``."""
    return F.date_format(micros_to_ts(micros_text), "yyyy-MM-dd")


def is_digits(c: Column) -> Column:
    """Only all-digit timestamps qualify for sub-day buckets."""
    return c.isNotNull() & c.rlike("^[0-9]+$")


def bucket_start(ts: Column, granularity: str) -> Column:
    """Start of the bucket holding ``ts``."""
    g = normalize_granularity(granularity)
    if g == "monthly":
        return F.date_trunc("month", ts)
    if g == "weekly":
        return F.date_trunc("week", ts)  # ISO week, Monday
    if g == "daily":
        return F.date_trunc("day", ts)
    hour = F.date_trunc("hour", ts)
    if g == "hourly":
        return hour
    n = 4 if g == "4hours" else 12
    return hour - F.make_dt_interval(F.lit(0), F.hour(ts) % n)


def bucket_label(start: Column, granularity: str) -> Column:
    """Bucket label text (the join key between spine and aggregates)."""
    g = normalize_granularity(granularity)
    if g == "monthly":
        return F.date_format(start, "yyyy-MM-01")
    if g == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), start).cast("string"), F.lit("-"),
                        F.lpad(F.weekofyear(start).cast("string"), 2, "0"))
    if g == "daily":
        return F.date_format(start, "yyyy-MM-dd")
    return F.date_format(start, "yyyy-MM-dd HH:00")


def event_bucket_ts(event_date: Column, event_timestamp: Column, granularity: str) -> Column:
    """Which time an event is bucketed by: event_date for day-or-coarser, else the timestamp."""
    g = normalize_granularity(granularity)
    if g in SUB_DAY:
        return micros_to_ts(event_timestamp)
    return event_date.cast("timestamp")


def spine_points(start_date: str, end_date: str, granularity: str) -> Column:
    """``generate_series(start 00:00:00, end 23:59:59, step)`` as an array column."""
    step = SPINE_STEP_HOURS[normalize_granularity(granularity)]
    return F.sequence(F.to_timestamp(F.lit(f"{start_date} 00:00:00")),
                      F.to_timestamp(F.lit(f"{end_date} 23:59:59")),
                      F.expr(f"INTERVAL {step} HOURS"))


def parse_date(text: str | None) -> Column | None:
    """``TO_DATE(text, 'YYYY-MM-DD')``."""
    return None if text is None else F.to_date(F.lit(text), "yyyy-MM-dd")
