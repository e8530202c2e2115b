"""Driver contract: entry() runs, every oracle key is a query, and every registered
query equals its DuckDB oracle on sf0.001 (row count + order-insensitive values)."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import VIEWS, rows_of  # noqa: E402
from sessionscope import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "tenant_id" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for v in VIEWS:
        p = f"{SF}/{v}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_aliases_are_the_same_query_under_a_second_name():
    assert all(registry.QUERIES[a] is registry.QUERIES[k] for a, k in registry.ALIASES.items())


# the training-data operators have their own tests beside them
@pytest.mark.parametrize("key", sorted(set(registry.QUERIES) - set(registry.ALIASES)))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    scols, srows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(scols) == sorted(dcols)
    assert rows_of(scols, srows) == rows_of(dcols, res.fetchall())


def test_plan_audit_detects_bad_shapes(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from plan_audit import BAD
    df = spark.range(10)
    w = df.withColumn("r", F.row_number().over(Window.orderBy("id")))._jdf.queryExecution().executedPlan().toString()
    assert BAD["window without partition key"].search(w) and BAD["single-partition exchange"].search(w)
    x = df.crossJoin(spark.range(3).withColumnRenamed("id", "j"))._jdf.queryExecution().executedPlan().toString()
    assert BAD["nested-loop join"].search(x)


def test_registered_plans_scale(spark):
    """No registered query plans a nested-loop join, a single-partition exchange or a
    window without a partition key."""
    from plan_audit import audit
    assert audit(spark, SF) == {}
