"""No caps, no lost days, and plans that hold at depth: re-ingest, paging, report, chart, ingest run, cluster safety."""

import datetime as dt
import decimal
import os
import uuid

import pytest
from pyspark.sql import functions as F

from sessionscope import session
from sessionscope.functions.text import days_ago_label
from sessionscope.operators.paging import take_page
from sessionscope.plans.chart import chart_data
from sessionscope.plans.report import branch_report_summary, branch_rollup, purchase_and_cart_samples
from sessionscope.plans.worklists import purchase_tasks, repeat_visit_tasks
from sessionscope.session import scratch_dir
from sessionscope.sources.fixtures import EVENT_TABLES, load_tables, warehouse_path
from sessionscope.sources.ingest import default_window, run_ingest
from sessionscope.streaming.reingest import incremental_reingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark):
    from sessionscope.sources.raw import raw_events
    return raw_events(load_tables(spark, SF).base)


@pytest.fixture
def landing(spark, raw):
    root = scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True)

    def land(number, rows, files=1):
        rows.repartition(files).write.parquet(f"{root}/landing/export_id={number}")

    def catch_up(**kw):
        incremental_reingest(spark, f"{root}/landing", f"{root}/wh", f"{root}/ckpt", raw_schema=raw.schema, **kw).awaitTermination()
        views = spark.read.schema("tenant_id string, event_date date, event_id long").parquet(f"{root}/wh/page_view")
        return {d.isoformat(): n for d, n in views.groupBy("event_date").count().collect()}
    return land, catch_up


def page_views(raw):
    return {f"{d[:4]}-{d[4:6]}-{d[6:]}": n for d, n in raw.filter("event_name = 'page_view'").groupBy("event_date").count().collect()}


def test_reingest_of_two_separate_days_keeps_the_days_between(raw, landing):
    land, catch_up = landing
    some = raw.filter(F.col("event_date").between("20240102", "20240108"))
    land(1, some)
    want = page_views(some)
    assert catch_up() == want
    land(2, some.filter(F.col("event_date") == "20240103"))
    land(3, some.filter(F.col("event_date") == "20240107"))
    assert catch_up() == want


def test_reingest_of_a_day_split_over_files_and_triggers(raw, landing):
    land, catch_up = landing
    some = raw.filter(F.col("event_date").between("20240102", "20240103"))
    land(1, some, files=3)
    assert catch_up(max_files_per_trigger=1) == page_views(some)


def test_reingest_takes_the_latest_export_of_a_day(raw, landing):
    land, catch_up = landing
    day = raw.filter(F.col("event_date") == "20240104")
    land(1, day)
    land(2, day.limit(3))
    land(3, day)
    assert catch_up() == page_views(day)
    land(4, day.filter("event_name <> 'page_view' or event_timestamp % 2 = 0"))
    assert catch_up() == page_views(day.filter("event_name <> 'page_view' or event_timestamp % 2 = 0"))


def test_report_adds_up_more_than_a_page(make_tables):
    rows = [dict(tenant_id="T0", event_date=dt.date(2024, 1, 1), event_timestamp=str(1704067200000000 + i), event_id=i, param_ga_session_id=f"s{i}",
                 user_prop_default_branch_id="D1", param_transaction_id=f"t{i}", ecommerce_purchase_revenue=decimal.Decimal(10)) for i in range(600)]
    t = make_tables(purchase=rows)
    got = branch_report_summary(t).first()
    assert (got["total_purchases"], got["total_revenue"], got["avg_order_value"]) == (600, 6000.0, 10.0)
    assert branch_rollup("purchases", t).first()["total_revenue"] == 6000.0
    assert purchase_and_cart_samples(t).count() == 600 and purchase_and_cart_samples(t, rows=500).count() == 500


def test_deep_pages_sort_no_whole_tenant(spark):
    """Beyond Spark's threshold the first phase cuts salts of a tenant, and the page is the same."""
    df = spark.range(9000).select(F.expr("concat('T', cast(id % 1 as string)) tenant_id"), F.pmod(F.col("id") * 7919, F.lit(9001)).alias("v"))
    deep = take_page(df, [F.col("v").desc()], 5, 1000)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and plan.count("hashpartitioning(tenant_id") == 2
    want = sorted((r.v for r in df.collect()), reverse=True)[4000:5000]
    assert [(r.row_num, r.v) for r in deep.orderBy("row_num").collect()] == list(enumerate(want, 4001))
    shallow = take_page(df, [F.col("v").desc()], 2, 25)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in shallow and "_salt" not in shallow


def test_chart_survives_a_timestamp_that_is_no_time(make_tables):
    row = dict(tenant_id="T0", event_date=dt.date(2024, 1, 1), param_ga_session_id="s")
    t = make_tables(page_view=[dict(row, event_timestamp="9" * 25), dict(row, event_timestamp="1704070800000000")])
    got = chart_data(t, "2024-01-01", "2024-01-01", "hourly").filter("visitors > 0").collect()
    assert [(r["date_group"], r["visitors"]) for r in got] == [("2024-01-01 01:00", 1)]
    assert chart_data(t, "2024-01-01", "2024-01-02", "daily").count() == 2


def test_repeat_page_reads_page_views_twice_and_items_of_the_page(spark):
    t = load_tables(spark, SF)
    plan = repeat_visit_tasks(t, page=1, limit=20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("param_page_location") and sum("user_prop_webuserid" in x and "Relation" in x for x in plan.splitlines()) <= 4
    physical = repeat_visit_tasks(t, page=1, limit=20)._jdf.queryExecution().executedPlan().toString()
    views = [x for x in physical.splitlines() if "FileScan" in x and "/page_view" in x]
    items = [x for x in physical.splitlines() if "FileScan" in x and "/view_item" in x]
    assert len(views) <= 2 and len(items) == 1


def test_report_plan_is_one_pass_a_worklist(spark):
    plan = branch_report_summary(load_tables(spark, SF))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and any(f"/{n}" in x for n in EVENT_TABLES)]
    assert len(scans) <= 8 and "dynamicpruning" not in plan


def test_each_extract_pushes_its_own_event_names(spark, tmp_path, raw):
    from sessionscope.sources.extract import extract_table, read_raw_export, scan_range, write_raw_export
    write_raw_export(raw, str(tmp_path / "raw"))
    landed = read_raw_export(spark, str(tmp_path / "raw"), raw.schema)
    plan = extract_table(landed, "purchase", "2024-01-03", "2024-01-05")._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "EqualTo(event_name,purchase)" in scan and "add_to_cart" not in scan and "PartitionFilters: [isnotnull(event_date" in scan
    assert {r[0] for r in scan_range(landed, "2024-01-03", "2024-01-05").select("event_date").distinct().collect()} <= {"20240103", "20240104", "20240105"}


def test_ingest_run_isolates_a_failing_type(spark, raw):
    from sessionscope.sources.extract import extract_table
    root = scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True)
    broken = extract_table(raw, "purchase", "2024-01-02", "2024-01-03").withColumn("param_page_title", F.raise_error(F.lit("bad")).cast("string"))
    run = run_ingest(spark, root, "2024-01-02", "2024-01-03", raw, extracted={"purchase": broken}, data_types=("events",))
    got = {(r.data_type): r.records for r in run.summary.groupBy("data_type").agg(F.sum("records").alias("records")).collect()}
    assert list(run.failed) == ["purchase"] and got["purchase"] == 0 and got["page_view"] > 0
    assert {r.status for r in run.summary.collect()} == {"completed_with_warnings"}
    again = run_ingest(spark, root, "2024-01-02", "2024-01-03", raw, data_types=("events",))
    assert not again.failed and {r.status for r in again.summary.collect()} == {"completed"}
    assert default_window(dt.date(2024, 3, 1)) == ("2024-02-28", "2024-03-01")
    with pytest.raises(ValueError):
        run_ingest(spark, root, "2024-01-02", "2024-01-01", raw)


def test_missing_date_label(spark):
    got = spark.createDataFrame([("2024-01-01",), ("2024-01-03",), (None,), ("",)], "d string").select(
        days_ago_label(F.expr("try_to_date(d)"), F.lit("2024-01-03")).alias("x")).collect()
    assert [r.x for r in got] == ["2 days ago", "Today", "Unknown", "Unknown"]


def test_checkpoint_folder_is_never_guessed_on_a_cluster():
    class Conf(dict):
        pass

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn", "getConf": staticmethod(lambda: {})})()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Spark())
    assert not session._one_process("local-cluster[2,1,1024]") and session._one_process("local[*]") and session._one_process("local")


def test_warehouse_name_follows_any_file_system(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    (tmp_path / "events.parquet" / "part-0.parquet").write_bytes(b"1")
    plain, qualified = warehouse_path(spark, str(tmp_path)), warehouse_path(spark, f"file:{tmp_path}")
    assert plain == qualified
    (tmp_path / "events.parquet" / "part-0.parquet").write_bytes(b"12")
    assert warehouse_path(spark, str(tmp_path)) != plain
    assert os.path.basename(plain).startswith("warehouse-")


def test_purchase_totals_survive_the_page(make_tables):
    rows = [dict(tenant_id="T0", event_date=dt.date(2024, 1, 1), event_timestamp=str(1704067200000000 + i), event_id=i) for i in range(30)]
    got = purchase_tasks(make_tables(purchase=rows), page=2, limit=20).collect()
    assert len(got) == 10 and {r["total_count"] for r in got} == {30}


def test_history_projection_fields_and_defaults(spark):
    from sessionscope.plans.report import history_projection
    at = "1704153600000000"
    rows = [("purchase", '{"transaction_id":"","revenue":12.50,"items":"[1]"}'), ("add_to_cart", '{"item_id":null,"item_name":"","price":2.50,"quantity":3}'),
            ("page_view", '{"page_location":"/product/","page_title":""}'), ("page_view", '{"page_location":"/about","page_title":"x"}'),
            ("view_item", '{"item_id":"P1","item_name":"N","price":1.25,"category":""}'), ("no_search_results", '{"search_term":""}')]
    line = spark.createDataFrame([("T0", "u", at, "", t, d) for t, d in rows], "tenant_id string, user_id string, event_timestamp string, session_id string, event_type string, details string")
    got = {(r.section, r.item_key): (r.event_day, r.name, r.category, r.value, r["items"], r.view_count) for r in history_projection(line).collect()}
    assert got == {("purchases", "unknown"): ("20240102", None, None, 12.5, "[1]", None),
                   ("carts", "unknown"): ("20240102", None, None, 7.5, "Unknown Item|unknown|3|2.50", None),
                   ("viewed_products", "unknown"): ("20240102", "Unknown Product", "Product", 0.0, None, 1),
                   ("viewed_products", "P1"): ("20240102", "N", "Product", 1.25, None, 1),
                   ("searches", "unknown"): ("20240102", None, None, 0.0, None, None)}
