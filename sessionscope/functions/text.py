"""Text helpers: money labels (S7/S8), duration and age labels (S15/S16),
product sku from url (S17), code labels (S18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Output convention for amounts: exact decimal rounded to 2, then double."""
    return F.round(c, 2).cast("double")


def currency_label(amount: Column) -> Column:
    """``'$' || COALESCE(sum, 0)::text`` -- decimal text, ``$0`` when NULL."""
    return F.when(amount.isNull(), F.lit("$0")).otherwise(F.concat(F.lit("$"), amount.cast("string")))


def parse_currency(text: Column) -> Column:
    """Strip ``$`` and ``,``; unparsable text gives NULL (skipped by sums)."""
    return F.regexp_replace(text, r"[$,]", "").try_cast("double")


def format_currency(amount: Column) -> Column:
    """``$1,234.56``."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def duration_label(start: Column, end: Column) -> Column:
    """Below a minute ``5s`` / ``1.5s`` (one decimal, trailing .0 dropped); below an
    hour ``14m``; else ``1h`` / ``1h 1m``. Missing or negative -> em dash."""
    ms = (F.unix_micros(end) - F.unix_micros(start)) / 1000.0
    total = F.floor(ms / 1000)
    r = F.round(ms / 1000.0, 1)
    secs = F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(F.format_string("%.1f", r))
    hours, mins = F.floor(total / 3600), F.floor((total % 3600) / 60)
    return (F.when(start.isNull() | end.isNull() | (ms < 0), F.lit("\u2014"))
            .when(total < 60, F.concat(secs, F.lit("s")))
            .when(hours > 0, F.when(mins > 0, F.concat(hours.cast("string"), F.lit("h "), mins.cast("string"),
                                                         F.lit("m")))
                  .otherwise(F.concat(hours.cast("string"), F.lit("h"))))
            .otherwise(F.concat(mins.cast("string"), F.lit("m"))))


def days_ago_label(d: Column, as_of: Column) -> Column:
    """Today / Yesterday / ``N days ago`` relative to ``as_of``; ``Unknown`` without a date."""
    n = F.datediff(F.to_date(as_of), F.to_date(d))
    return (F.when(n.isNull(), F.lit("Unknown")).when(n == 0, F.lit("Today")).when(n == 1, F.lit("Yesterday"))
            .otherwise(F.concat(n.cast("string"), F.lit(" days ago"))))


def url_last_segment(url: Column) -> Column:
    """Product sku = last path segment of a ``/product/`` url, else NULL."""
    return F.when(url.contains("/product/"), F.element_at(F.split(url, "/"), -1))


def search_type_label(code: Column) -> Column:
    """Facet label of a search type code."""
    return (F.when(code == "no_results", F.lit("No Results"))
            .when(code == "no_conversion", F.lit("No Conversion")).otherwise(code))
