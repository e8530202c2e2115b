"""Bucketed upserts, pages by sampled ranges, the set of purchased sessions, sketches and late contacts."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from sessionscope.operators.paging import select_pages
from sessionscope.plans.chart import chart_data
from sessionscope.plans.locations import location_stats
from sessionscope.plans.overview import overview_stats
from sessionscope.plans.report import search_term_samples
from sessionscope.plans.sketches import ERROR_BOUND, approximate_visitors, daily_sketches
from sessionscope.plans.worklists import cart_abandonment_tasks, search_analysis_tasks
from sessionscope.session import children, scratch_dir
from sessionscope.sources.buckets import merge_buckets, read_buckets
from sessionscope.sources.fixtures import load_tables
from sessionscope.sources.masters import normalize_tenant_id

SF = "/root/testdata/sf0.001"


@pytest.fixture
def root(spark):
    return scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_upsert_rewrites_only_its_buckets(spark, root):
    keys = ["tenant_id", "user_id"]
    frame = lambda rows: spark.createDataFrame(rows, "tenant_id string, user_id string, email string, is_active boolean")
    old = frame([(f"T{i % 2}", f"u{i}", "old", False) for i in range(200)])
    first = merge_buckets(spark, f"{root}/users", old, keys, buckets=8)
    assert sorted(first) == list(range(8))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(8))
    one = [tuple(r)[:4] for r in old.filter(bucket == 3).limit(2).collect()]
    second = merge_buckets(spark, f"{root}/users", frame([(t, u, "new", False) for t, u, _, _ in one] * 2), keys, buckets=99)
    assert list(second) == [3] and second[3] != first[3]
    for b in set(range(8)) - {3}:
        assert [n for n, _, _ in children(spark, f"{root}/users/data/upsert_bucket={b}") if n.startswith("upsert_version=")] == [first[b].rsplit("/", 1)[1]]
    got = {(r.tenant_id, r.user_id): (r.email, r.is_active) for r in read_buckets(spark, f"{root}/users", old.schema).collect()}
    assert len(got) == 200 and {k for k, v in got.items() if v[0] == "new"} == {(t, u) for t, u, _, _ in one} and all(v[1] for v in got.values())
    third = merge_buckets(spark, f"{root}/users", frame([(t, u, "last", False) for t, u, _, _ in one]), keys)
    kept = {n for n, _, _ in children(spark, f"{root}/users/data/upsert_bucket=3") if n.startswith("upsert_version=")}
    assert kept == {second[3].rsplit("/", 1)[1], third[3].rsplit("/", 1)[1]}          # two versions are kept
    assert [n for n, _, _ in children(spark, f"{root}/users/versions") if n.startswith("v")] == ["v00000002", "v00000003"]
    assert merge_buckets(spark, f"{root}/users", frame([]), keys) == {} and read_buckets(spark, f"{root}/none", old.schema).count() == 0


def test_a_reader_of_a_version_is_not_disturbed(spark, root):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    merge_buckets(spark, f"{root}/t", frame([("a", 1), ("b", 1)]), ["k"], buckets=2)
    before = read_buckets(spark, f"{root}/t", "k string, v int")
    merge_buckets(spark, f"{root}/t", frame([("a", 2), ("c", 2)]), ["k"])
    assert sorted(map(tuple, before.collect())) == [("a", 1), ("b", 1)]
    assert sorted(map(tuple, read_buckets(spark, f"{root}/t", "k string, v int").collect())) == [("a", 2), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("pages", [[(0, 7)], [(4990, 30)], [(1234, 5), (2500, 1), (0, 2), (4000, 600)], [(9999, 5)]])
def test_pages_by_ranges_at_every_depth(spark, pages):
    df = spark.range(6000).select(F.when(F.col("id") % 6 < 5, F.lit("T0")).when(F.col("id") % 12 == 5, F.lit("T1")).alias("tenant_id"),
                                  F.when(F.col("id") % 10 > 0, F.pmod(F.col("id") * 7919, F.lit(50))).alias("v"), "id")
    order = [F.col("v").desc_nulls_last(), F.col("id").asc()]
    got = sorted(((r.tenant_id, r.row_num, r.v, r.id) for r in select_pages(df, order, pages, ranges=9).collect()), key=str)
    want = []
    rows = df.collect()
    for tenant in ("T0", "T1", None):
        own = sorted((r for r in rows if r.tenant_id == tenant), key=lambda r: (r.v is None, -(r.v or 0), r.id))
        want += [(tenant, i, r.v, r.id) for i, r in enumerate(own, 1) if any(o < i <= o + n for o, n in pages)]
    assert got == sorted(want, key=str)


def test_a_deep_page_reads_few_ranges(spark):
    df = spark.range(40000).select(F.lit("T0").alias("tenant_id"), F.pmod(F.col("id") * 7919, F.lit(40009)).alias("v"))
    page = select_pages(df, [F.col("v").asc()], [(30000, 10)], ranges=20)
    files = [f for f in page.inputFiles()]
    ranges = {x for x in plan(page).split("_range#")[0:0]} or {f.split("_range=")[1].split("/")[0] for f in files if "_range=" in f}
    assert len(ranges) == 20                              # all were written
    scan = next(x for x in plan(page).splitlines() if "FileScan" in x and "PartitionFilters" in x and "_range" in x)
    wanted = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "IN" not in wanted.upper().split("_RANGE")[0] and wanted.count(",") <= 4    # one or two ranges are read again
    assert [r.row_num for r in page.orderBy("row_num").collect()] == list(range(30001, 30011))


def test_nobody_shuffles_the_purchases_for_the_anti_join(spark):
    t = load_tables(spark, SF)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for df, own in ((overview_stats(t, "2024-01-01", "2024-01-31"), 1), (chart_data(t, "2024-01-01", "2024-01-31", "daily"), 1),
                    (location_stats(t, "2024-01-01", "2024-01-31"), 1), (cart_abandonment_tasks(t), 0), (search_analysis_tasks(t), 0)):
        scans = [x for x in plan(df).splitlines() if "FileScan" in x]
        purchases = [x for x in scans if "/purchase]" in x or "/purchase," in x]
        # the purchases are read for the revenue of the range alone, and only their sessions for the anti-join
        assert len(purchases) <= own and all("param_ga_session_id" not in x.split("ReadSchema")[1] for x in purchases)
        assert any("/purchased_sessions" in x for x in scans)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_sketches_answer_any_range_without_the_events(spark, root):
    t = load_tables(spark, SF)
    daily_sketches(t).write.parquet(f"{root}/sketches")
    stored = spark.read.parquet(f"{root}/sketches")
    for lo, hi in (("2024-01-01", "2024-01-31"), ("2024-01-09", "2024-01-11")):
        found = approximate_visitors(stored, lo, hi, by=("tenant_id", "user_prop_default_branch_id"))
        assert "/page_view" not in plan(found)
        exact = {(r[0], r[1]): (r[2], r[3]) for r in t.page_view.filter(F.col("event_date").between(dt.date.fromisoformat(lo), dt.date.fromisoformat(hi))).groupBy(
            "tenant_id", "user_prop_default_branch_id").agg(F.count_distinct("param_ga_session_id"), F.count_distinct("user_prop_webuserid")).collect()}
        rows = found.collect()
        assert len(rows) == len(exact)
        for r in rows:
            for estimate, truth in zip(r[2:], exact[r[0], r[1]], strict=True):
                assert abs(estimate - truth) <= ERROR_BOUND * truth + 1


def test_contacts_are_listed_after_the_terms_are_ranked(spark):
    text = search_term_samples(load_tables(spark, SF))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    listed = [i for i, x in enumerate(text) if "collect_list" in x]
    ranked = [i for i, x in enumerate(text) if "row_number" in x and "Window" in x]
    assert listed and ranked and min(ranked) > max(listed)            # the list is built above the ranking


def test_a_null_tenant_stays_null(spark):
    got = spark.createDataFrame([(None,), ("x",), ("",)], "t string").select(normalize_tenant_id(F.col("t")).alias("u")).collect()
    assert got[0].u is None and len(got[1].u) == 36 and len(got[2].u) == 36 and got[1].u != got[2].u
