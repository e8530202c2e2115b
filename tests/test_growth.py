"""Queries whose figures grew faster than their input: plans and rows after the change."""

import datetime as dt


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dispatch_plan_deals_the_jobs_of_a_branch_out(make_tables):
    from sessionscope.plans.report import dispatch_plan
    day = dt.date(2024, 1, 2)
    jobs = [dict(tenant_id="T0", job_id=f"j{i}", report_date=day, status="queued", target_branches=branches)
            for i, branches in enumerate([["D1"], ["D1", "D2"], [], None, ["D9"], ["D1", None]])]
    maps = [dict(tenant_id=t, branch_code=b, sales_rep_email=f"{e}@x", sales_rep_name=e, is_enabled=on)
            for t, b, e, on in (("T0", "D1", "a", True), ("T0", "D1", "b", True), ("T0", "D2", "c", True), ("T0", "D2", "d", False), ("T1", "D1", "e", True))]
    locations = [dict(tenant_id="T0", warehouse_code="D1", warehouse_name="One")]
    plan = dispatch_plan(make_tables(email_sending_jobs=jobs, branch_email_mappings=maps, locations=locations))
    want = sorted((job["job_id"], m["branch_code"], m["sales_rep_name"], f"Daily Branch Sales Report - 2024-01-02 - {m['branch_code']}", "One" if m["branch_code"] == "D1" else None)
                  for job in jobs for m in maps if m["tenant_id"] == "T0" and m["is_enabled"] and (not job["target_branches"] or m["branch_code"] in job["target_branches"]))
    assert sorted((r.job_id, r.branch_code, r.sales_rep_name, r.subject, r.location_name) for r in plan.collect()) == want
    joins = [x for x in physical(plan).splitlines() if "Join" in x and "Inner" in x]
    assert joins and all("SortMergeJoin" in x and "_part" in x for x in joins)


def test_dispatch_plan_makes_its_rows_in_many_tasks_however_little_it_reads(spark, make_tables):
    """What the join reads is small beside its rows: the tasks that make them are not merged by what they read."""
    from pyspark.sql import functions as F

    from sessionscope.plans.report import DISPATCH_TASKS, dispatch_plan
    jobs = [dict(tenant_id="T0", job_id=f"j{i}", report_date=dt.date(2024, 1, 2), status="queued", target_branches=["D1"] if i % 2 else None) for i in range(400)]
    maps = [dict(tenant_id="T0", branch_code="D1", sales_rep_email=f"{i}@x", sales_rep_name=f"{i}", is_enabled=True) for i in range(20)]
    plan = dispatch_plan(make_tables(email_sending_jobs=jobs, branch_email_mappings=maps))
    rows = [r["count"] for r in plan.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 400 * 20 and plan.select("job_id", "sales_rep_email").distinct().count() == 400 * 20
    assert len(rows) >= DISPATCH_TASKS and max(rows) <= 400 * 20 // 8


def test_a_query_writes_only_the_tables_that_it_reads(spark, tmp_path):
    import os
    import shutil

    from sessionscope.registry import QUERIES
    from sessionscope.sources.fixtures import load_tables, warehouse_path
    sf = str(tmp_path / "sf")
    shutil.copytree("/root/testdata/sf0.001", sf)    # a path of its own: nothing is stored for it yet
    stored = lambda: {x for x in os.listdir(root) if ".building" not in x} if os.path.isdir(root) else set()
    root = warehouse_path(spark, sf)
    t = load_tables(spark, sf)
    for key in ("i8_extract_all_event_types", "i11_parse_event_date", "s6_parse_date"):
        assert QUERIES[key][0](spark, sf).count() > 0 and stored() == set()
    assert t.email_send_history.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() and stored() == set()
    for key in ("s14_json_parse_products", "l2_limit_offset_page", "p3_optional_date_range"):
        assert QUERIES[key][0](spark, sf).count() > 0 and stored() == {"purchase"}
    for key in ("l5_top_10_terms", "q6_search_analysis_tasks"):
        assert QUERIES[key][0](spark, sf).count() > 0
        assert stored() == {"purchase", "purchased_sessions", "no_search_results", "view_search_results"}


def test_history_projection_ranks_rows_that_nobody_sorted(spark):
    from sessionscope.registry import QUERIES
    assert "rangepartitioning" not in physical(QUERIES["r15_history_projection"][0](spark, "/root/testdata/sf0.001"))


def test_reingest_lands_no_export_through_one_task(spark, tmp_path):
    import os

    from sessionscope.registry import QUERIES
    from sessionscope.session import ensure_checkpoint_dir
    roots = lambda: {x for x in os.listdir(ensure_checkpoint_dir(spark)) if x.startswith("st1-")}
    before, size = roots(), "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(size, "1b")    # as many tasks as a large input would have
    try:
        QUERIES["st1_incremental_reingest"][0](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(size)
    root = os.path.join(ensure_checkpoint_dir(spark), *(roots() - before))
    files = {n: [x for x in os.listdir(f"{root}/landing/export_id={n}") if x.endswith(".parquet")] for n in range(1, 6)}
    assert all(len(found) >= 4 for found in files.values())
    for found in files[1]:
        assert spark.read.parquet(f"{root}/landing/export_id=1/{found}").count() > 0
    # the second export still comes in two triggers that share its days
    index = spark.read.parquet(f"{root}/checkpoint/export-index").filter("export_id = 2")
    days = [{r[0] for r in index.filter(f"batch = {b}").select("event_date").collect()} for b in sorted(r[0] for r in index.select("batch").distinct().collect())]
    assert len(days) == 2 and days[0] == days[1] != set()


def test_followed_tables_are_replaced_side_by_side(spark, monkeypatch):
    import threading

    from sessionscope.registry import followed_tables
    from sessionscope.sources import sinks
    from sessionscope.sources.fixtures import load_tables
    from sessionscope.streaming.rollups import contributions
    sf, names, real = "/root/testdata/sf0.001", ["no_search_results", "view_search_results"], sinks.replace_date_range
    together, steps = threading.Barrier(len(names), timeout=60), []

    def replace(spark, path, *rest, **kw):
        if len(steps) < len(names):
            together.wait()    # broken, and so an error, unless all tables get here at the same time
        steps.append(path)
        return real(spark, path, *rest, **kw)

    monkeypatch.setattr(sinks, "replace_date_range", replace)
    rollups, t = followed_tables(spark, sf, names), load_tables(spark, sf)
    assert len(steps) == 4 * len(names)
    for name in names:
        want = contributions(getattr(t, name)).select(*rollups[name].columns)
        assert rollups[name].exceptAll(want).isEmpty() and want.exceptAll(rollups[name]).isEmpty()
