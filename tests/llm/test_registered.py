"""Registered queries against their DuckDB SQL on the small tables, the native ones without Python, and the pipeline against brute force."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools"), os.path.dirname(os.path.abspath(__file__))]

import corpus_pipeline  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from sessionscope.llm.queries import QUERIES  # noqa: E402
from test_text_operators import brute_contamination, brute_links, brute_repeats, corpus, words  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("key", [k for k, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, duck, key):
    query, sql = QUERIES[key]
    df = query(spark, SF)
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("key", ["op1_language_id", "op5_warc_derivatives", "op7_host_suffix_array"])
def test_query_returns_every_row(spark, key):
    table, times = {"op1_language_id": ("documents", 1), "op5_warc_derivatives": ("pages", 2), "op7_host_suffix_array": ("pages", 1)}[key]
    assert QUERIES[key][0](spark, SF).count() == times * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op1_language_id"][0](spark, SF).where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.97 * len(found) > 0


@pytest.mark.parametrize("key", ["op4_preference_format", "op6_quality_cascade", "op9_url_list_join"])
def test_native_plans_have_no_python(spark, key):
    plan = QUERIES[key][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage equals the definition, on its own input."""
    texts = corpus(9, 50)
    items = [(1, " ".join(words(texts[3])[2:16])), (2, "not in any document at all")]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t or ""), None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns[:len(columns)] == columns
        seen.append(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    has_letter = [(i, t) for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")]
    assert seen[0] == has_letter
    groups = brute_links(has_letter)[1]
    first = [r for j, r in enumerate(has_letter) if groups.index(groups[j]) == j]
    assert seen[1] == first and len(first) < len(has_letter)
    gone = brute_repeats(first, 20)
    cut = [(i, " ".join(w for p, w in enumerate(words(t)) if p not in gone[i, t]) if gone[i, t] else t) for i, t in first]
    cut = [(i, t) for i, t in cut if words(t)]
    assert seen[2] == cut and cut != first
    clean = [r for r, c in zip(cut, brute_contamination(cut, items)) if not c[-1]]
    assert seen[3] == clean and len(clean) < len(cut)
    assert {r for r in seen[4]} <= set(clean) and len(seen[4]) > 0
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in final.collect()) == seen[4]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
