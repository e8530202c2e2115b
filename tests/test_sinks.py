"""Ingest sinks and flattening: I13/I14/I15 properties on hand-made rows."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from sessionscope.session import children, scratch_dir
from sessionscope.sources.extract import reclassify_search_events
from sessionscope.sources.masters import extract_users, normalize_locations, read_location_file
from sessionscope.sources.sinks import (SUMMARY_TYPES, ingest_run_summary, latest_version, persist_upsert, replace_date_range,
                                        upsert, upsert_users)


def _rows(spark, items):
    return spark.createDataFrame(items, "tenant_id string, event_date date, v long")


def test_replace_date_range_is_idempotent_and_clears_range(spark):
    path = os.path.join(scratch_dir(spark, f"t-{uuid.uuid4().hex}"), "tbl")
    d = lambda n: dt.date(2024, 1, n)
    _rows(spark, [("T0", d(1), 1), ("T0", d(2), 2), ("T0", d(3), 3), ("T1", d(2), 9)]) \
        .write.partitionBy("tenant_id", "event_date").parquet(path)
    new = spark.createDataFrame([(d(2), 20)], "event_date date, v long")
    for _ in range(2):
        assert replace_date_range(spark, path, "T0", "2024-01-02", "2024-01-03", new) == "replaced"
        got = sorted((r.tenant_id, r.event_date.day, r.v) for r in spark.read.parquet(path).collect())
        # day 3 of T0 had no new rows: cleared; T1 untouched
        assert got == [("T0", 1, 1), ("T0", 2, 20), ("T1", 2, 9)]


def test_replace_with_empty_batch_is_skipped(spark):
    path = os.path.join(scratch_dir(spark, f"t-{uuid.uuid4().hex}"), "tbl")
    _rows(spark, [("T0", dt.date(2024, 1, 1), 1)]).write.partitionBy("tenant_id", "event_date").parquet(path)
    empty = spark.createDataFrame([], "event_date date, v long")
    assert replace_date_range(spark, path, "T0", "2024-01-01", "2024-01-01", empty) == "skipped"
    assert spark.read.parquet(path).count() == 1
    assert replace_date_range(spark, path, "T0", "2024-01-01", "2024-01-01", empty, skip_if_empty=False) == "replaced"
    assert spark.read.schema("tenant_id string, event_date date, v long").parquet(path).count() == 0


def test_replace_leaves_days_outside_the_range(spark):
    """A row dated outside the range neither replaces its day nor is added to it."""
    path = os.path.join(scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True), "tbl")
    d = lambda n: dt.date(2024, 1, n)
    _rows(spark, [("T0", d(1), 1), ("T0", d(5), 5), ("T/1 x", d(1), 9)]).write.partitionBy("tenant_id", "event_date").parquet(path)
    new = _rows(spark, [("T0", d(1), 10), ("T0", d(5), 50), ("T/1 x", d(2), 20), ("T0", None, 7)])
    for _ in range(2):
        replace_date_range(spark, path, None, "2024-01-01", "2024-01-02", new)
        got = sorted((r.tenant_id, r.event_date.day, r.v) for r in spark.read.parquet(path).collect())
        assert got == [("T/1 x", 2, 20), ("T0", 1, 10), ("T0", 5, 5)]


def test_upsert_is_deterministic_without_an_order_column(spark):
    old = spark.createDataFrame([], "tenant_id string, user_id string, email string, is_active boolean")
    new = spark.createDataFrame([("T0", "u1", e) for e in "bca"], "tenant_id string, user_id string, email string")
    for parts in (1, 3):
        assert [r.email for r in upsert_users(old, new.repartition(parts)).collect()] == ["c"]


def test_persisted_upserts_make_versions(spark):
    path = os.path.join(scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True), "users")
    frame = lambda rows: spark.createDataFrame(rows, "tenant_id string, user_id string, email string, is_active boolean, seq int")
    assert latest_version(spark, path) is None
    persist_upsert(spark, path, frame([("T0", "u", "a", False, 1), ("T1", "u", "x", False, 1)]), ["tenant_id", "user_id"], order_col="seq")
    persist_upsert(spark, path, frame([("T0", "u", "b", False, 1), ("T0", "u", "c", False, 2)]), ["tenant_id", "user_id"], order_col="seq")
    third = persist_upsert(spark, path, frame([("T0", "v", "d", False, 1)]), ["tenant_id", "user_id"], order_col="seq")
    assert latest_version(spark, path) == third and third.endswith("v00000003")
    got = sorted(tuple(r) for r in spark.read.parquet(third).select("tenant_id", "user_id", "email", "is_active").collect())
    assert got == [("T0", "u", "c", True), ("T0", "v", "d", True), ("T1", "u", "x", True)]
    assert [n for n, _, _ in children(spark, path) if n.startswith("v")] == ["v00000002", "v00000003"]


def test_run_summary_zero_fills_and_warns(spark):
    rows = spark.createDataFrame([("T0",), ("T0",), ("T1",)], "tenant_id string")
    got = {(r.tenant_id, r.data_type): (r.records, r.status) for r in ingest_run_summary({"purchase": rows, "users_processed": rows.limit(0)}, ["view_item"]).collect()}
    assert len(got) == 2 * len(SUMMARY_TYPES) and got["T0", "purchase"] == (2, "completed_with_warnings") and got["T1", "users_processed"][0] == 0
    plan = ingest_run_summary({"purchase": rows, "page_view": rows})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2                              # every input once


def test_users_of_two_tenants_stay_apart(spark):
    master = spark.createDataFrame([("T0", "7", "a"), ("T1", "7", "b"), ("T0", None, "c"), ("T1", "NaN", "d")], "tenant_id string, USER_ID string, Name string").selectExpr(
        "*", "'NaN' CUSTOMER_NAME", "'E' CUSTOMER_ERP_ID", "Name EMAIL", "Name OFFICE_PHONE", "Name CELL_PHONE")
    got = sorted((r.tenant_id, str(r.user_id), r.user_name, r.buying_company_name) for r in extract_users(master).collect())
    assert got == [("T0", "7", "a", None), ("T1", "7", "b", None), ("T1", "None", "d", None)]


def test_location_headers(spark, tmp_path):
    df = spark.createDataFrame([("1", "a", "low"), ("nan", "b", "x"), (" ", "c", "y")], "WAREHOUSE_ID string, WAREHOUSE_CODE string, city string")
    out = normalize_locations(df)
    assert out.columns == ["warehouse_id", "warehouse_code", "city"] and [tuple(r) for r in out.collect()] == [("1", "a", "low")]
    clean = spark.createDataFrame([("1", "N", "9")], "warehouse_id string, warehouse_name string, zip string")
    assert [tuple(r) for r in normalize_locations(clean).collect()] == [("1", "N", "9")]
    both = spark.createDataFrame([("1", None, "Old"), ("2", "New", "Old")], "WAREHOUSE_ID string, LOCATION_NAME string, WAREHOUSE_NAME string")
    assert [r.warehouse_name for r in normalize_locations(both).orderBy("warehouse_id").collect()] == ["Old", "New"]
    (tmp_path / "l.csv").write_text("WAREHOUSE_ID,PROVINCE,POSTAL_CODE,MANAGER\n5,Ontario,01234,x\n")
    assert [tuple(r) for r in read_location_file(spark, str(tmp_path / "l.csv")).collect()] == [("5", "Ontario", "01234")]


def test_upsert_dedupes_and_keeps_absent_rows(spark):
    old = spark.createDataFrame([("T0", "u1", "old", False), ("T0", "u2", "keep", False)],
                                "tenant_id string, user_id string, email string, is_active boolean")
    new = spark.createDataFrame([("T0", "u1", "a", 1), ("T0", "u1", "b", 2), ("T0", "u3", "c", 1)],
                                "tenant_id string, user_id string, email string, seq int")
    got = sorted(tuple(r) for r in upsert(old, new, ["tenant_id", "user_id"], order_col="seq")
                 .select("tenant_id", "user_id", "email", "is_active").collect())
    assert got == [("T0", "u1", "b", True), ("T0", "u2", "keep", False), ("T0", "u3", "c", True)]


def test_reclassify_preserves_rows_and_handles_null_title(spark):
    nsr = spark.createDataFrame([("No Results Found - x", "a"), ("Search", "b"), (None, "c"), ("no results found", "d")],
                                "param_page_title string, param_no_search_results_term string")
    vsr = spark.createDataFrame([("Search", "z")], "param_page_title string, param_search_term string")
    out = reclassify_search_events({"no_search_results": nsr, "view_search_results": vsr})
    assert [r.param_no_search_results_term for r in out["no_search_results"].collect()] == ["a"]
    assert sorted(r.param_search_term for r in out["view_search_results"].collect()) == ["b", "c", "d", "z"]
    assert out["no_search_results"].count() + out["view_search_results"].count() == nsr.count() + vsr.count()


def test_kv_lookup_mixed_int_and_string(spark):
    from sessionscope.functions.kv import first_item, kv_int_first, kv_string_first
    schema = ("p array<struct<key:string, value:struct<string_value:string, int_value:bigint>>>, "
              "items array<struct<item_id:string>>")
    df = spark.createDataFrame([([("ga_session_id", (None, 7)), ("page_title", ("T", None)), ("x", ("s", 5))], []),
                                ([("ga_session_id", ("8", None))], None)], schema)
    rows = df.select(kv_int_first(F.col("p"), "ga_session_id"), kv_string_first(F.col("p"), "page_title"),
                     kv_string_first(F.col("p"), "x"), kv_int_first(F.col("p"), "x"),
                     first_item(F.col("items"), "item_id")).collect()
    assert tuple(rows[0]) == ("7", "T", "s", "5", None)
    assert tuple(rows[1]) == ("8", None, None, None, None)
