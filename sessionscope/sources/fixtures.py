"""Derive the engine's tables from the driver's TPC-H-ish parquet files.

The rules are those of FIXTURES.md. Every table is a lazy DataFrame over the
given parquet files, so the work of every query grows with its inputs. The
same rules are written independently in DuckDB SQL in ``sessionscope.oracle``.

Event tables carry the reference's flat columns plus ``event_id`` (the
source row id, used as unique tie-breaker in paged results).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.session import apply_required_conf

EVENT_TABLES = ("purchase", "add_to_cart", "page_view", "view_search_results",
                "no_search_results", "view_item")

COMMON_EVENT_COLUMNS = [
    "event_id", "tenant_id", "event_date", "event_timestamp", "user_pseudo_id",
    "user_prop_webuserid", "user_prop_default_branch_id", "user_prop_webcustomerid",
    "param_ga_session_id", "param_page_title", "param_page_location",
    "device_category", "device_operating_system", "geo_country", "geo_city",
]

# Fixed values of the fixture rules (FIXTURES.md).
SESSION_EPOCH = "2024-01-01"   # sessions are cut every 3 days from this date
SESSION_DAYS = 3
NO_RESULTS_TITLE = "No Results Found"


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _code(c: Column) -> Column:
    """'D' + two-digit zero-padded number (branch / warehouse code)."""
    return F.concat(F.lit("D"), F.lpad(_s(c), 2, "0"))


def _tenant(c: Column) -> Column:
    return F.concat(F.lit("T"), _s(c % 2))


def base_events(events: DataFrame, customer: DataFrame) -> DataFrame:
    """FIXTURES §1: one flat row per source event, plus helper columns."""
    cust = customer.select(F.col("c_custkey"), F.col("c_nationkey"))
    e = events.join(cust, events.user_id == cust.c_custkey, "left")
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    event_date = F.to_date(F.col("ts"))
    is_error = F.col("event_type") == "error"
    return e.select(
        F.col("event_id"),
        _tenant(F.col("user_id")).alias("tenant_id"),
        event_date.alias("event_date"),
        _s(F.unix_micros(ts)).alias("event_timestamp"),
        F.concat(F.lit("px"), _s("user_id")).alias("user_pseudo_id"),
        F.when(F.col("user_id") % 10 != 0, _s("user_id")).alias("user_prop_webuserid"),
        F.concat(F.lit("ERP"), _s(F.expr("user_id div 4"))).alias("user_prop_webcustomerid"),
        _code(F.col("c_nationkey")).alias("user_prop_default_branch_id"),
        _s(F.col("user_id") * 1000
           + F.expr(f"datediff(to_date(ts), date'{SESSION_EPOCH}') div {SESSION_DAYS}")
           ).alias("param_ga_session_id"),
        k.alias("k"),
        F.col("event_type"),
        F.col("value"),
    ).select(
        "*",
        F.when(F.col("k") % 4 == 0, F.concat(F.lit("/product/P"), _s("k")))
         .otherwise(F.concat(F.lit("/page/"), _s(F.col("k") % 20))).alias("param_page_location"),
        F.when(is_error, F.when(F.col("k") % 3 == 0, F.lit(NO_RESULTS_TITLE)).otherwise(F.lit("Search")))
         .otherwise(F.concat(F.lit("Page "), _s(F.col("k") % 20))).alias("param_page_title"),
        F.when(F.col("k") % 2 == 0, "mobile").otherwise("desktop").alias("device_category"),
        F.element_at(F.array(F.lit("iOS"), F.lit("Android"), F.lit("Windows")),
                     (F.col("k") % 3 + 1).cast("int")).alias("device_operating_system"),
        F.lit("US").alias("geo_country"),
        F.concat(F.lit("City "), _s(F.col("k") % 7)).alias("geo_city"),
    )


def _items_json(k: Column) -> Column:
    return F.concat(
        F.lit('[{"item_id":"P'), _s(k), F.lit('","item_name":"Item '), _s(k % 10),
        F.lit('","price":'), _s(k + 1), F.lit(',"quantity":'), _s(k % 5 + 1), F.lit("}]"))


def _first_item(k: Column, value: Column, with_quantity: bool) -> list[Column]:
    cols = [
        F.concat(F.lit("P"), _s(k)).alias("first_item_item_id"),
        F.concat(F.lit("Item "), _s(k % 10)).alias("first_item_item_name"),
        F.concat(F.lit("Cat "), _s(k % 5)).alias("first_item_item_category"),
        value.cast("decimal(10,2)").alias("first_item_price"),
    ]
    if with_quantity:
        cols.append((k % 5 + 1).cast("int").alias("first_item_quantity"))
    return cols


def event_tables(base: DataFrame) -> dict[str, DataFrame]:
    """FIXTURES §2: the six final (already reclassified) event tables."""
    k, et = F.col("k"), F.col("event_type")
    common = [F.col(c) for c in COMMON_EVENT_COLUMNS]
    term = F.concat(F.lit("term "), _s(k % 15))
    return {
        "purchase": base.filter(et == "purchase").select(
            *common,
            F.concat(F.lit("TX"), _s("event_id")).alias("param_transaction_id"),
            (F.col("value").cast("decimal(15,2)") * 5).cast("decimal(15,2)").alias("ecommerce_purchase_revenue"),
            _items_json(k).alias("items_json")),
        "add_to_cart": base.filter(et == "click").select(
            *common, *_first_item(k, F.col("value"), True), _items_json(k).alias("items_json")),
        "page_view": base.filter(et.isin("view", "signup")).select(
            *common, F.concat(F.lit("/page/"), _s(k % 5)).alias("param_page_referrer")),
        "view_item": base.filter(et == "signup").select(
            *common, *_first_item(k, F.col("value"), False), _items_json(k).alias("items_json")),
        "no_search_results": base.filter((et == "error") & (k % 3 == 0)).select(
            *common, term.alias("param_no_search_results_term")),
        "view_search_results": base.filter((et == "error") & (k % 3 != 0)).select(
            *common, term.alias("param_search_term")),
    }


def users_table(customer: DataFrame) -> DataFrame:
    """FIXTURES §4 users: customer master; ERP ids are shared by 4 users (fan-out)."""
    ck = F.col("c_custkey")
    return customer.filter(ck % 7 != 3).select(
        _tenant(ck).alias("tenant_id"),
        _s(ck).alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.concat(F.lit("Company "), _s(ck % 40)).alias("buying_company_name"),
        F.concat(F.lit("ERP"), _s(F.expr("c_custkey div 4"))).alias("buying_company_erp_id"),
        F.concat(F.lit("u"), _s(ck), F.lit("@example.org")).alias("email"),
        F.concat(F.lit("+1-555-"), F.lpad(_s(ck % 10000), 4, "0")).alias("office_phone"),
        F.when(ck % 5 != 0, F.concat(F.lit("+1-777-"), F.lpad(_s(ck % 10000), 4, "0"))).alias("cell_phone"),
        F.lit(True).alias("is_active"),
    )


def locations_table(nation: DataFrame, region: DataFrame) -> DataFrame:
    """FIXTURES §4 locations: every nation is a warehouse, for both tenants."""
    n = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    nk = F.col("n_nationkey")
    return n.select(
        F.explode(F.array(F.lit("T0"), F.lit("T1"))).alias("tenant_id"),
        _s(nk).alias("warehouse_id"),
        _code(nk).alias("warehouse_code"),
        F.col("n_name").alias("warehouse_name"),
        F.concat(F.lit("City "), _s(nk)).alias("city"),
        F.col("r_name").alias("state"),
        (nk % 7 != 0).alias("is_active"),
    )


def branch_email_mappings_table(supplier: DataFrame) -> DataFrame:
    sk = F.col("s_suppkey")
    return supplier.select(
        _tenant(sk).alias("tenant_id"),
        _code(F.col("s_nationkey")).alias("branch_code"),
        F.concat(F.lit("Branch "), F.lpad(_s("s_nationkey"), 2, "0")).alias("branch_name"),
        F.concat(F.lit("rep"), _s(sk), F.lit("@example.org")).alias("sales_rep_email"),
        F.col("s_name").alias("sales_rep_name"),
        (sk % 4 != 0).alias("is_enabled"),
    )


def _job_status(c: Column) -> Column:
    return (F.when(c == "F", "completed").when(c == "O", "queued")
            .when(c == "P", "processing").otherwise("failed"))


def processing_jobs_table(orders: DataFrame) -> DataFrame:
    ok = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp")
    status = _job_status(F.col("o_orderstatus"))
    return orders.select(
        F.concat(F.lit("job_"), _s(ok)).alias("id"),
        _tenant(F.col("o_custkey")).alias("tenant_id"),
        F.concat(F.lit("job_"), _s(ok)).alias("job_id"),
        status.alias("status"),
        F.lit('["events"]').alias("data_types"),
        F.date_sub(F.to_date("o_orderdate"), 2).alias("start_date"),
        F.to_date("o_orderdate").alias("end_date"),
        F.concat(F.lit('{"current":"events","retrigger_count":'), _s(ok % 5), F.lit("}")).alias("progress"),
        F.concat(F.lit('{"purchase":'), _s(ok % 50), F.lit(',"page_view":'), _s(ok % 900),
                 F.lit("}")).alias("records_processed"),
        F.lit(None).cast("string").alias("error_message"),
        created.alias("created_at"),
        (created + F.expr("INTERVAL 60 SECONDS")).alias("started_at"),
        F.when(status == "completed", F.timestamp_seconds(F.unix_seconds(created) + ok % 7200)).alias("completed_at"),
        created.alias("updated_at"),
    )


def email_sending_jobs_table(orders: DataFrame) -> DataFrame:
    ok = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp")
    status = _job_status(F.col("o_orderstatus"))
    total = (ok % 5 + 1).cast("int")
    return orders.select(
        _tenant(F.col("o_custkey")).alias("tenant_id"),
        F.concat(F.lit("email_"), _s(ok)).alias("job_id"),
        status.alias("status"),
        F.to_date("o_orderdate").alias("report_date"),
        F.array(_code(F.col("o_custkey") % 25)).alias("target_branches"),
        total.alias("total_emails"),
        F.when(status == "completed", total).otherwise(F.lit(0)).alias("emails_sent"),
        F.lit(0).alias("emails_failed"),
        F.lit(None).cast("string").alias("error_message"),
        created.alias("created_at"),
        created.alias("updated_at"),
        (created + F.expr("INTERVAL 60 SECONDS")).alias("started_at"),
        F.when(status == "completed", F.timestamp_seconds(F.unix_seconds(created) + ok % 7200)).alias("completed_at"),
    )


def email_send_history_table(lineitem: DataFrame) -> DataFrame:
    lk = F.col("l_orderkey")
    report_date = F.to_date("l_shipdate")
    branch = _code(F.col("l_suppkey") % 25)
    failed = F.col("l_returnflag") == "R"
    return lineitem.select(
        F.concat_ws("-", _s(lk), _s("l_partkey"), _s("l_linenumber")).alias("id"),
        _tenant(lk).alias("tenant_id"),
        F.concat(F.lit("email_"), _s(lk)).alias("job_id"),
        branch.alias("branch_code"),
        F.concat(F.lit("rep"), _s("l_suppkey"), F.lit("@example.org")).alias("sales_rep_email"),
        F.concat(F.lit("Rep "), _s("l_suppkey")).alias("sales_rep_name"),
        F.concat(F.lit("Daily Branch Sales Report - "), _s(report_date), F.lit(" - "), branch).alias("subject"),
        report_date.alias("report_date"),
        F.when(failed, "failed").otherwise("sent").alias("status"),
        F.when(~failed, F.lit("250 OK")).alias("smtp_response"),
        F.when(failed, F.lit("mailbox unavailable")).alias("error_message"),
        F.col("l_shipdate").cast("timestamp").alias("sent_at"),
    )


@dataclass
class Tables:
    """The engine's logical tables (lazy DataFrames)."""

    purchase: DataFrame
    add_to_cart: DataFrame
    page_view: DataFrame
    view_search_results: DataFrame
    no_search_results: DataFrame
    view_item: DataFrame
    users: DataFrame
    locations: DataFrame
    branch_email_mappings: DataFrame | None = None
    processing_jobs: DataFrame | None = None
    email_sending_jobs: DataFrame | None = None
    email_send_history: DataFrame | None = None
    base: DataFrame | None = None
    purchased: DataFrame | None = field(default_factory=lambda: None)    # no class attribute: LazyTables makes it
    extra: dict = field(default_factory=dict)

    def with_purchase(self) -> DataFrame:
        """(tenant, session) of the sessions with a purchase at any time (J2): the maintained set where the warehouse has one,
        else the purchases themselves."""
        return self.purchase if self.purchased is None else self.purchased

    def events(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in EVENT_TABLES}

    def with_events(self, change: Callable[[DataFrame], DataFrame]) -> Tables:
        """The same tables with a change to the event tables; only those that are then used are made."""
        return LazyTables(self, lambda name: self.purchased if name == "purchased" else change(getattr(self, name)))


#: What is made on first use.
LAZY = (*EVENT_TABLES, "purchased")


class LazyTables(Tables):
    """Tables whose event tables are made when they are first used, so that a query pays for those that it reads."""

    def __init__(self, other: Tables, make: Callable[[str], DataFrame | None]):
        self.__dict__.update({f.name: getattr(other, f.name) for f in fields(Tables) if f.name not in LAZY}, _make=make)

    def __getattr__(self, name: str):    # what __init__ has left out
        if name not in LAZY:
            raise AttributeError(name)
        self.__dict__[name] = made = self._make(name)
        return made


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def derive_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All tables, derived lazily (plans only) from the parquet under ``sf_dir``."""
    apply_required_conf(spark)
    src = lambda n: read_source(spark, sf_dir, n)
    base = base_events(src("events"), src("customer"))
    ev = event_tables(base)
    return Tables(
        **ev,
        users=users_table(src("customer")),
        locations=locations_table(src("nation"), src("region")),
        branch_email_mappings=branch_email_mappings_table(src("supplier")),
        processing_jobs=processing_jobs_table(src("orders")),
        email_sending_jobs=email_sending_jobs_table(src("orders")),
        email_send_history=email_send_history_table(src("lineitem")),
        base=base,
        extra={"sf_dir": sf_dir},
    )


# Storage layout of the warehouse: event tables by (tenant, day) -- partition
# pruning for every tenant/date-scoped query and the unit of I14's replace --
# and the sessions with a purchase by tenant. Masters, jobs and histories are a projection of
# one source table each: they are read from it, with the columns that a query needs, and not copied.
EVENT_PARTITIONING = ("tenant_id", "event_date")
DIM_PARTITIONING = ("tenant_id",)

PURCHASED = "purchased_sessions"
PURCHASED_SCHEMA = "param_ga_session_id string, tenant_id string"

_OPEN: dict[tuple[str, str], Tables] = {}


def _source_signature(spark: SparkSession, sf_dir: str) -> str:
    """Qualified folder, and names, sizes and modification times of the source files, of any file system."""
    from sessionscope.session import children, file_system
    fs, p = file_system(spark, sf_dir)
    parts = [fs.makeQualified(p).toString()]
    for name, length, changed in children(spark, sf_dir):
        inner = children(spark, f"{sf_dir.rstrip('/')}/{name}") if length < 0 else []
        parts += [f"{name}/{n}:{size}:{t}" for n, size, t in inner] or [f"{name}:{length}:{changed}"]
    return "|".join(parts)


def warehouse_path(spark: SparkSession, sf_dir: str) -> str:
    """Warehouse folder for ``sf_dir`` under the shared checkpoint folder; the name
    changes when the source files change, so a stale build is never reused."""
    import hashlib
    from sessionscope.session import scratch_dir
    tag = hashlib.md5((_source_signature(spark, sf_dir) + f"|v{WAREHOUSE_VERSION}").encode()).hexdigest()[:16]
    return scratch_dir(spark, f"warehouse-{tag}")


# bump when the table derivation or layout changes
WAREHOUSE_VERSION = 3


def write_partitioned(df: DataFrame, path: str, parts, mode: str = "overwrite") -> None:
    """Hive-style partitioned Parquet write. The REBALANCE hint lets AQE shuffle rows
    by the partition columns, so each (tenant, day) lands in few files written in
    parallel, while skewed partitions are split and tiny ones coalesced."""
    df.hint("rebalance", *parts).write.mode(mode).partitionBy(*parts).parquet(path)


def open_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(os.path.join(root, name))        # explicit schema: partition column types kept


def stored_table(spark: SparkSession, root: str, name: str, rows: DataFrame, parts, schema=None) -> DataFrame:
    """A table of the warehouse, written (the ingest step) unless it is there already."""
    from sessionscope.session import path_exists, rename_path
    path = os.path.join(root, name)
    if not path_exists(spark, path):
        # build privately, then publish with one rename: a half-built table is never opened (a concurrent
        # builder that published first wins; ours is left unused)
        private = f"{path}.building-{uuid.uuid4().hex}"
        write_partitioned(rows, private, parts)
        rename_path(spark, private, path)
    return open_table(spark, root, name, schema or rows.schema)


def open_warehouse(spark: SparkSession, sf_dir: str, root: str) -> Tables:
    d = derive_tables(spark, sf_dir)
    d.extra["warehouse"] = root

    def make(name: str) -> DataFrame:
        if name != "purchased":
            return stored_table(spark, root, name, getattr(d, name), EVENT_PARTITIONING)
        # what J2 needs of the purchases; for tables that change, streaming.rollups.purchased_sessions keeps it up
        sessions = d.purchase.select("tenant_id", "param_ga_session_id").filter("param_ga_session_id is not null").distinct()
        return stored_table(spark, root, PURCHASED, sessions, DIM_PARTITIONING, PURCHASED_SCHEMA)

    return LazyTables(d, make)


def build_warehouse(t: Tables) -> None:
    """Write every table of the warehouse now, whatever is used."""
    for name in LAZY:
        getattr(t, name)


def load_tables(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Tables:
    """The engine's tables for ``sf_dir``.

    ``materialize=True`` (default): an event table is written once, when a query first uses it, under the shared
    ``spark.checkpoint.dir`` (see ``session.ensure_checkpoint_dir``), and every query reads that warehouse --
    as the reference queries its ingested tables. ``False``: plans over the raw
    parquet only (nothing written).
    """
    apply_required_conf(spark)
    if not materialize:
        return derive_tables(spark, sf_dir)
    root = warehouse_path(spark, sf_dir)
    key = (spark.sparkContext.applicationId, root)
    if key not in _OPEN:
        _OPEN[key] = open_warehouse(spark, sf_dir, root)
    return _OPEN[key]
