"""The trigram index answers as ``ilike`` does and reads fewer files."""

import uuid

import pytest
from pyspark.sql import functions as F

from sessionscope.operators.textindex import add_to_index, candidate_files, literals, search, trigrams_of
from sessionscope.session import scratch_dir

SCHEMA = "id long, text string, tenant_id string, event_date date"


@pytest.fixture(scope="module")
def table(spark):
    root = scratch_dir(spark, f"t-{uuid.uuid4().hex}", temporary=True)
    words = ["Copper Pipe", "steel BOLT 10%", "wooden_door", "Ärmel", None, "", "ab", "pipe\\cutter", "Fuse 16A", "İstanbul lamp"]
    rows = [(i, w and f"{w} {i % 3}", f"T{i % 2}", f"2024-01-0{i % 5 + 1}") for i, w in enumerate(words * 3)]
    frame = spark.createDataFrame(rows, "id long, text string, tenant_id string, day string").withColumn("event_date", F.to_date("day")).drop("day")
    frame.repartition("tenant_id", "event_date").write.partitionBy("tenant_id", "event_date").parquet(f"{root}/table")
    return spark.read.schema(SCHEMA).parquet(f"{root}/table"), f"{root}/index", f"{root}/table"


@pytest.mark.parametrize("pattern", ["pipe", "PIPE", "copper pipe 0", "10%", "10\\%", "n_door", "wooden\\_d", "o%r", "ab", "a", "", "ärm", "ÄRMEL", "nothing like it", "pipe\\\\c", "fuse 1_a", "istanbul", "lamp"])
def test_search_equals_ilike(table, pattern):
    rows, index, _ = table
    add_to_index(rows, "text", index)
    want = sorted(map(tuple, rows.where(F.col("text").ilike(f"%{pattern}%")).collect()))
    found = search(rows, "text", pattern, index)
    assert found.columns == rows.columns and sorted(map(tuple, found.collect())) == want


def test_fewer_files_are_read(table):
    rows, index, _ = table
    add_to_index(rows, "text", index)
    assert add_to_index(rows, "text", index) == 0
    every = len(rows.inputFiles())
    assert len(candidate_files(rows, "fuse", index)) < len(candidate_files(rows, "zz", index)) == every
    assert candidate_files(rows, "nothing like it", index) == []
    assert len(search(rows, "text", "fuse", index).inputFiles()) == len(candidate_files(rows, "fuse", index)) <= 3


def test_an_index_that_lags_behind(spark, table):
    rows, index, path = table
    add_to_index(rows, "text", index)
    spark.createDataFrame([(900, "a brand new fuse box")], "id long, text string").write.parquet(f"{path}/tenant_id=T9/event_date=2024-02-01")
    now = spark.read.schema(SCHEMA).parquet(path)
    for _ in range(2):
        assert {r.id for r in search(now, "text", "fuse", index, [F.col("tenant_id") == "T9"]).collect()} == {900}
        assert add_to_index(now, "text", index) >= 0
    assert add_to_index(now, "text", index) == 0


def test_literals_of_patterns():
    assert literals("a%b_c") == ["a", "b", "c"] and literals("10\\%x") == ["10%x"] and literals("") == [] and literals("a\\\\b") == ["a\\b"]
    assert trigrams_of("AbCd") == ["abc", "bcd"] and trigrams_of("ab%cd") == [] and trigrams_of("abcÄdef") == ["abc", "def"]
