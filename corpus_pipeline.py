"""Corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

All stages but the last return the columns they were given, whatever their names; columns other than doc_id, text, lang,
source and n_chars pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.llm.decontaminate import find_contamination
from sessionscope.llm.frames import written
from sessionscope.llm.jaccard import keep_first
from sessionscope.llm.langid import UNDETERMINED, identify, train
from sessionscope.llm.mixing import mix
from sessionscope.llm.substring import remove_repeats


def _masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under neutral column names, so that no column clashes with an operator's; and the names of the known ones."""
    names = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without text or without a letter go."""
    rows, at = _masked(docs)
    model = train(rows, at["doc_id"], at["text"], at["lang"])
    judged = identify(rows, model, at["text"], tuple(rows.columns))
    return judged.where(F.col("lang_pred") != UNDETERMINED).select(*rows.columns).toDF(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 80 % of common five-word shingles: the one with the smallest id."""
    return keep_first(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that an earlier document has; documents with no word left go."""
    rows, at = _masked(docs)
    kept = remove_repeats(rows, doc_id=at["doc_id"], text=at["text"], carry=tuple(rows.columns))
    changed = F.col("n_removed") > 0
    new = {at["text"]: F.col("kept_text")} | ({at["n_chars"]: F.when(changed, F.length("kept_text")).otherwise(F.col(at["n_chars"])).cast(rows.schema[at["n_chars"]].dataType)} if "n_chars" in at else {})
    return kept.where(~changed | (F.col("n_removed") < F.col("n_words"))).select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns]).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of a benchmark window."""
    rows, at = _masked(docs)
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=at["text"], carry=tuple(rows.columns))
    return found.where(~F.col("contaminated")).select(*rows.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate draws, in global random order; adds copy and shuffle_key."""
    return mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
]

#: The language model has no SQL form; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every earlier stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
