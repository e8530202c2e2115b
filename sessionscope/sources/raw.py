"""Raw inputs of the ingest (FIXTURES §3-§4), derived from the driver parquet:

* ``raw_events``: nested GA4-style export rows (key/value arrays, items array,
  device/geo structs), one row per (event, event name) -- a signup is both a
  page_view and a view_item; failed searches are partly mistagged.
* ``raw_customer_master``: upper-case header customer file with some NULL ids.
* ``raw_locations_file``: location file with alias headers, ``"nan"`` and blank ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.sources.fixtures import NO_RESULTS_TITLE, _code, _s


def _kv(key: str, string_value: Column | None = None, int_value: Column | None = None) -> Column:
    return F.struct(F.lit(key).alias("key"),
                    F.struct((string_value if string_value is not None else F.lit(None)).cast("string")
                             .alias("string_value"),
                             (int_value if int_value is not None else F.lit(None)).cast("bigint")
                             .alias("int_value")).alias("value"))


def _kv_list(*entries: tuple[Column, Column]) -> Column:
    """Array of (present?, entry); absent entries are dropped (NULL values omit the key)."""
    arr = F.array(*[F.when(present, e) for present, e in entries])
    return F.filter(arr, lambda x: x.isNotNull())


def raw_events(base: DataFrame) -> DataFrame:
    k, et = F.col("k"), F.col("event_type")
    names = (F.when(et == "purchase", F.array(F.lit("purchase")))
             .when(et == "click", F.array(F.lit("add_to_cart")))
             .when(et == "view", F.array(F.lit("page_view")))
             .when(et == "signup", F.array(F.lit("page_view"), F.lit("view_item")))
             .when(k % 3 == 2, F.array(F.lit("view_search_results")))
             .when(k % 6 == 0, F.array(F.lit("view_search_results_no_results")))
             .otherwise(F.array(F.lit("no_search_results"))))
    e = base.select("*", F.explode(names).alias("event_name"))
    even = F.col("event_id") % 2 == 0
    uid, sid = F.col("user_prop_webuserid"), F.col("param_ga_session_id")
    name = F.col("event_name")
    is_failed_name = name.isin("no_search_results", "view_search_results_no_results")
    term = F.concat(F.lit("term "), _s(k % 15))
    item_price = F.when(name == "purchase", (k + 1).cast("double")).otherwise(F.col("value"))
    items = F.when(name.isin("purchase", "add_to_cart", "view_item"), F.array(F.struct(
        F.concat(F.lit("P"), _s(k)).alias("item_id"),
        F.concat(F.lit("Item "), _s(k % 10)).alias("item_name"),
        F.concat(F.lit("Cat "), _s(k % 5)).alias("item_category"),
        item_price.alias("price"),
        (k % 5 + 1).cast("bigint").alias("quantity")))).otherwise(F.array())
    revenue = (F.col("value").cast("decimal(15,2)") * 5).cast("double")
    return e.select(
        "tenant_id",
        F.date_format("event_date", "yyyyMMdd").alias("event_date"),
        F.col("event_timestamp").cast("bigint").alias("event_timestamp"),
        "event_name",
        "user_pseudo_id",
        _kv_list(
            (uid.isNotNull(), F.when(even, _kv("WebUserId", int_value=uid.cast("bigint")))
             .otherwise(_kv("WebUserId", string_value=uid))),
            (F.col("user_prop_webcustomerid").isNotNull(),
             _kv("WebCustomerId", string_value=F.col("user_prop_webcustomerid"))),
            (F.col("user_prop_default_branch_id").isNotNull(),
             _kv("default_branch_id", string_value=F.col("user_prop_default_branch_id"))),
        ).alias("user_properties"),
        _kv_list(
            (sid.isNotNull(), F.when(even, _kv("ga_session_id", int_value=sid.cast("bigint")))
             .otherwise(_kv("ga_session_id", string_value=sid))),
            (F.lit(True), _kv("page_title", string_value=F.col("param_page_title"))),
            (F.lit(True), _kv("page_location", string_value=F.col("param_page_location"))),
            (name == "page_view", _kv("page_referrer", string_value=F.concat(F.lit("/page/"), _s(k % 5)))),
            (name == "purchase", _kv("transaction_id", string_value=F.concat(F.lit("TX"), _s("event_id")))),
            (name == "view_search_results", _kv("search_term", string_value=term)),
            (is_failed_name, _kv("no_search_results_term", string_value=term)),
        ).alias("event_params"),
        F.when(name == "purchase", F.struct(revenue.alias("purchase_revenue"))).alias("ecommerce"),
        items.alias("items"),
        F.struct(F.col("device_category").alias("category"),
                 F.col("device_operating_system").alias("operating_system")).alias("device"),
        F.struct(F.col("geo_country").alias("country"), F.col("geo_city").alias("city")).alias("geo"),
    )


def raw_customer_master(customer: DataFrame) -> DataFrame:
    ck = F.col("c_custkey")
    return customer.select(
        F.when(ck % 7 != 3, ck).alias("USER_ID"),
        F.col("c_name").alias("Name"),
        F.concat(F.lit("Company "), _s(ck % 40)).alias("CUSTOMER_NAME"),
        F.concat(F.lit("ERP"), _s(F.expr("c_custkey div 4"))).alias("CUSTOMER_ERP_ID"),
        F.concat(F.lit("u"), _s(ck), F.lit("@example.org")).alias("EMAIL"),
        F.concat(F.lit("+1-555-"), F.lpad(_s(ck % 10000), 4, "0")).alias("OFFICE_PHONE"),
        F.when(ck % 5 != 0, F.concat(F.lit("+1-777-"), F.lpad(_s(ck % 10000), 4, "0"))).alias("CELL_PHONE"),
        (ck % 2).alias("_tenant_bit"),
    )


def raw_locations_file(nation: DataFrame, region: DataFrame) -> DataFrame:
    n = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    nk = F.col("n_nationkey")
    return n.select(
        F.when(nk % 5 == 1, F.lit("nan")).when(nk % 5 == 2, F.lit("  ")).otherwise(_s(nk)).alias("WAREHOUSE_ID"),
        _code(nk).alias("WAREHOUSE_CODE"),
        F.col("n_name").alias("LOCATION_NAME"),
        F.concat(F.lit("City "), _s(nk)).alias("CITY"),
        F.col("r_name").alias("PROVINCE"),
        _s(10000 + nk * 7).alias("POSTAL_CODE"),
        F.lit("unused").alias("MANAGER"),
    )
