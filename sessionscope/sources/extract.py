"""Ingest: scan the nested export for a date range (I1), flatten it (I2-I7), fan out
all six event types from one scan (I8), parse dates (I11) and move mistagged
failed searches to the successful-search table (I13).

The flattening is one ``select`` over the raw scan -- key/value lookups use
``filter`` + ``get`` on the arrays (no explode, no row multiplication) -- so the
six tables come from a single pass that can be written partitioned by
(event_table, tenant_id, event_date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.functions.kv import first_item, kv_int_first, kv_string_first, to_json_keep_nulls
from sessionscope.sources.fixtures import COMMON_EVENT_COLUMNS, NO_RESULTS_TITLE

# Which raw event names feed which table.
EVENT_NAMES = {
    "purchase": ("purchase",),
    "add_to_cart": ("add_to_cart",),
    "page_view": ("page_view",),
    "view_search_results": ("view_search_results",),
    "no_search_results": ("no_search_results", "view_search_results_no_results"),
    "view_item": ("view_item",),
}
TABLE_OF_NAME = {n: t for t, names in EVENT_NAMES.items() for n in names}

EXTRA_COLUMNS = {
    "purchase": ["param_transaction_id", "ecommerce_purchase_revenue", "items_json"],
    "add_to_cart": ["first_item_item_id", "first_item_item_name", "first_item_item_category",
                    "first_item_price", "first_item_quantity", "items_json"],
    "page_view": ["param_page_referrer"],
    "view_search_results": ["param_search_term"],
    "no_search_results": ["param_no_search_results_term"],
    "view_item": ["first_item_item_id", "first_item_item_name", "first_item_item_category",
                  "first_item_price", "items_json"],
}


def parse_event_date(c: Column) -> Column:
    """8-digit ``yyyyMMdd`` text -> DATE; ISO ``yyyy-MM-dd`` text passes through; else NULL."""
    return (F.when(c.rlike(r"^\d{8}$"), F.try_to_date(c, "yyyyMMdd"))
            .otherwise(F.try_to_date(c, "yyyy-MM-dd")))


def scan_range(raw: DataFrame, start: str | None, end: str | None, event_names=None) -> DataFrame:
    """Inclusive ``yyyy-MM-dd`` range on the ``yyyyMMdd`` date suffix, optional event
    names. ``None`` bounds are open (a streaming micro-batch carries its own range)."""
    out = raw
    if start is not None:
        out = out.filter(F.col("event_date") >= start.replace("-", ""))
    if end is not None:
        out = out.filter(F.col("event_date") <= end.replace("-", ""))
    if event_names:
        out = out.filter(F.col("event_name").isin(list(event_names)))
    return out


def write_raw_export(raw: DataFrame, path: str) -> None:
    """Land a raw export partitioned by day (``event_date=yyyyMMdd``): the layout that I1 prunes."""
    raw.hint("rebalance", "event_date").write.partitionBy("event_date").parquet(path)


def read_raw_export(spark, path: str, schema) -> DataFrame:
    """A landed raw export; the day stays text, so a range is a partition filter."""
    return spark.read.schema(schema).parquet(path)


def flatten_events(raw: DataFrame, start: str | None, end: str | None, event_names=None) -> DataFrame:
    """I2-I7 in one pass: a wide flat row per raw event (of ``event_names``, default all) with its target ``event_table``."""
    r = scan_range(raw, start, end, list(event_names or TABLE_OF_NAME))
    up, ep, items = F.col("user_properties"), F.col("event_params"), F.col("items")
    table = F.lit(None).cast("string")
    for n, tname in TABLE_OF_NAME.items():
        table = F.when(F.col("event_name") == n, F.lit(tname)).otherwise(table)
    raw_json = to_json_keep_nulls(F.struct("event_date", "event_timestamp", "event_name", "user_pseudo_id",
                                           "user_properties", "event_params", "ecommerce", "items",
                                           "device", "geo"))
    return r.select(
        table.alias("event_table"),
        F.xxhash64("tenant_id", "event_date", "event_timestamp", "event_name", "user_pseudo_id",
                   kv_int_first(ep, "ga_session_id"), kv_string_first(ep, "page_location"),
                   first_item(items, "item_id"), kv_string_first(ep, "transaction_id")).alias("event_id"),
        F.col("tenant_id"),
        parse_event_date(F.col("event_date")).alias("event_date"),
        F.col("event_timestamp").cast("string").alias("event_timestamp"),
        F.col("user_pseudo_id"),
        kv_int_first(up, "WebUserId").alias("user_prop_webuserid"),
        kv_string_first(up, "default_branch_id").alias("user_prop_default_branch_id"),
        kv_int_first(up, "WebCustomerId").alias("user_prop_webcustomerid"),
        kv_int_first(ep, "ga_session_id").alias("param_ga_session_id"),
        kv_string_first(ep, "page_title").alias("param_page_title"),
        kv_string_first(ep, "page_location").alias("param_page_location"),
        F.col("device.category").alias("device_category"),
        F.col("device.operating_system").alias("device_operating_system"),
        F.col("geo.country").alias("geo_country"),
        F.col("geo.city").alias("geo_city"),
        kv_string_first(ep, "transaction_id").alias("param_transaction_id"),
        F.col("ecommerce.purchase_revenue").cast("decimal(15,2)").alias("ecommerce_purchase_revenue"),
        to_json_keep_nulls(items).alias("items_json"),
        first_item(items, "item_id").alias("first_item_item_id"),
        first_item(items, "item_name").alias("first_item_item_name"),
        first_item(items, "item_category").alias("first_item_item_category"),
        first_item(items, "price").cast("decimal(10,2)").alias("first_item_price"),
        first_item(items, "quantity").cast("int").alias("first_item_quantity"),
        kv_string_first(ep, "page_referrer").alias("param_page_referrer"),
        kv_string_first(ep, "search_term").alias("param_search_term"),
        kv_string_first(ep, "no_search_results_term").alias("param_no_search_results_term"),
        raw_json.alias("raw_data"),
    )


EVENT_COLUMNS = COMMON_EVENT_COLUMNS + list(dict.fromkeys(c for extra in EXTRA_COLUMNS.values() for c in extra))


def extract_events(raw: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """I8 in one pass: the rows of all six types with ``event_table``, each with the columns of its own table (others NULL)."""
    flat = flatten_events(raw, start, end)
    kept = {c: [t for t, extra in EXTRA_COLUMNS.items() if c in extra] for c in EVENT_COLUMNS[len(COMMON_EVENT_COLUMNS):]}
    return flat.select("event_table", *COMMON_EVENT_COLUMNS, *[F.when(F.col("event_table").isin(tables), F.col(c)).alias(c) for c, tables in kept.items()], "raw_data")


def reclassified(events: DataFrame) -> DataFrame:
    """I13 on the rows of ``extract_events``: a failed search without the marker in its title becomes a successful one."""
    moved = (F.col("event_table") == "no_search_results") & ~F.coalesce(F.col("param_page_title"), F.lit("")).contains(NO_RESULTS_TITLE)
    failed_term = F.col("param_no_search_results_term")
    return events.withColumns({"event_table": F.when(moved, F.lit("view_search_results")).otherwise(F.col("event_table")),
                               "param_search_term": F.when(moved, failed_term).otherwise(F.col("param_search_term")),
                               "param_no_search_results_term": F.when(~moved, failed_term)})


def table_view(flat: DataFrame, table: str) -> DataFrame:
    """One event table's rows and columns out of the wide flat frame."""
    cols = COMMON_EVENT_COLUMNS + EXTRA_COLUMNS[table] + ["raw_data"]
    return flat.filter(F.col("event_table") == table).select(*cols)


def extract_table(raw: DataFrame, table: str, start: str | None, end: str | None) -> DataFrame:
    """One event table; its own event names reach the scan."""
    return table_view(flatten_events(raw, start, end, EVENT_NAMES[table]), table)


def extract_all(raw: DataFrame, start: str | None, end: str | None) -> dict[str, DataFrame]:
    """I8 as lazy frames: each type (before reclassification) over its own event names. ``extract_events`` has all of
    them in one pass; ``ingest.stage_events`` writes that, and falls back to these frames to isolate a failure."""
    return {t: extract_table(raw, t, start, end) for t in EVENT_NAMES}


def reclassify_search_events(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Failed-search rows whose title lacks the marker (NULL title lacks it) are
    successful searches: moved to view_search_results with the term column renamed."""
    nsr = tables.get("no_search_results")
    if nsr is None:
        return tables
    has_marker = F.coalesce(F.col("param_page_title"), F.lit("")).contains(NO_RESULTS_TITLE)
    out = dict(tables)
    out["no_search_results"] = nsr.filter(has_marker)
    moved = nsr.filter(~has_marker).withColumnRenamed("param_no_search_results_term", "param_search_term")
    vsr = tables.get("view_search_results")
    out["view_search_results"] = moved if vsr is None else vsr.unionByName(moved, allowMissingColumns=True)
    return out
