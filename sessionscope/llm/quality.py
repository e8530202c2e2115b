"""Quality rules as a short-circuit cascade, in built-in functions only.

Base counts are computed for every document. Further rules are ordered on a bounded sample: each rule's cost is
its running time there and its selectivity the share that it rejects; rules run by rejection per cost, the best
first, inside one CASE, which stops at the first rule that rejects. The verdict does not depend on the order.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.frames import words, written

MIN_WORDS = 50
#: Words inside repeated 3-word windows, in hundredths of all words.
MAX_REPEATED = 50
#: Rows on which costs and selectivities are estimated (about; the verdict does not use the sample).
SAMPLE_ROWS = 2000
#: How often every rule is timed.
ROUNDS = 3

_SPACES = " \t\n\x0b\x0c\r"
_CAPITALS = r"\p{Lu}"


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _window_hashes(w: str) -> Column:
    """64-bit hashes of the 3-word windows of one document. No lambda here or below looks outside its own arguments: a filter
    that is pushed under these projections then repeats them once, not once an element."""
    n = F.size(w) - 2
    return F.transform(F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n)), lambda x: F.xxhash64(x["0"], x["1"], x["2"]))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, body and the base counts. Each step is a projection of its own, so no array is built twice.

    Words inside repeated 3-word windows: (window hash, place) pairs are sorted and neighbours compared; the sort is
    skipped where all windows of a document differ.
    """
    n = F.size("w")
    step = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    step = step.select("*", words(F.col("body")).alias("w"), F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    step = step.select("*", F.when(n < 3, F.array().cast("array<bigint>")).otherwise(_window_hashes("w")).alias("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select("*", F.when(F.size(F.array_distinct("windows")) == F.size("windows"), none).otherwise(placed).alias("placed"))
    m = F.greatest(F.size("placed") - 1, F.lit(0))
    twice = F.zip_with(F.slice("placed", 1, m), F.slice("placed", 2, m), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_distinct(F.flatten(twice))
    places = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    return step.select(
        "doc_id", "body", n.cast("bigint").alias("n_words"), (F.length("body") - _count_of(F.col("body"), _SPACES)).cast("bigint").alias("word_chars"),
        _count_of(F.col("body"), "#*$%&|<>").cast("bigint").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(places).cast("bigint").alias("n_repeat_words"), F.size("lines").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEATED) * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Name -> whether it rejects a document with words. All are exact counts over the whole text."""
    return {
        "symbols": F.lit(10) * F.col("n_symbols") > F.col("n_words"),
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (F.lit(10) * F.col("n_dup_lines") > F.lit(3) * F.col("n_lines")),
        "word_length": (F.col("word_chars") < F.lit(2) * F.col("n_words")) | (F.col("word_chars") > F.lit(20) * F.col("n_words")),
        "capitals": F.lit(10) * F.regexp_count("body", F.lit(_CAPITALS)) > F.lit(4) * F.col("word_chars"),
        "exclamations": F.lit(10) * _count_of(F.col("body"), "!") > F.lit(4) * F.col("n_words"),
        "ellipses": F.lit(10) * F.regexp_count("body", F.lit(r"(\.\.\.|…)[\x20\x09-\x0D]*(\n|$)")) > F.lit(3) * F.col("n_lines"),
        "bullets": F.lit(10) * F.regexp_count("body", F.lit(r"(?m)^[\x20\x09]*[-*•‣]")) > F.lit(9) * F.col("n_lines"),
        "letterless_words": F.lit(10) * F.regexp_count("body", F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])")) > F.lit(5) * F.col("n_words"),
    }


def estimate_order(sample: DataFrame, named: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, rejected share, seconds a row) by rejection per cost, the best first; ties by name.

    ``sample`` has the base counts. Each rule runs alone over it, less the time of an empty pass; one row a rule comes back. All are run in
    ``ROUNDS`` rounds and the shortest time counts: what else the machine does only adds to a time, and hits no rule in every round.
    """
    def run(column: Column) -> tuple[int, int, float]:
        start = time.perf_counter()
        n, hits = sample.agg(F.count("*"), F.count_if(column)).first()
        return n, hits, time.perf_counter() - start

    passes = {"": F.lit(False), **named}
    run(passes[""])
    rounds = [{name: run(column) for name, column in passes.items()} for _ in range(ROUNDS)]
    shortest = {name: min(r[name][2] for r in rounds) for name in passes}
    found = []
    for name in named:
        n, hits, _ = rounds[0][name]
        found.append((name, hits / max(n, 1), max(shortest[name] - shortest[""], 1e-4) / max(n, 1)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0]))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and failed_rule (the first rule that
    rejected, in the cascade's order; ``base``; null if kept) for every row.

    Nulls and edges: a null or wordless text has zero counts and fails the base rules. A null doc_id stays null; rows
    that repeat are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    counted = features(docs, doc_id, text)
    named = rules()
    n = docs.count()
    sample = written(features(docs if n <= sample_rows else docs.sample(sample_rows / n, seed=17), doc_id, text), "quality-sample")
    order = [name for name, _, _ in estimate_order(sample.where(~base_failed()), named)]
    cascade = F.when(base_failed(), F.lit("base"))
    for name in order:
        cascade = cascade.when(named[name], F.lit(name))
    judged = counted.withColumn("failed_rule", cascade)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("failed_rule").isNull().alias("kept"), "failed_rule")
