"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Both sides are lower-cased (A-Z only) and cut into words; every distinct word of the
benchmark becomes one symbol, every other word one shared "unknown" symbol. A window of
ten benchmark words is then a ten-symbol pattern, and a document is scanned once as a
string of symbols, so a match position is a word index. Word indexes are mapped back to
character offsets of the original text for the documents that have a match.

The automaton is broadcast. Its size is bounded: distinct items, long ones cut into overlapping pieces, are dealt into blocks of
about ``BLOCK_BYTES`` of text, and each block is one pass over the documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.llm.frames import pick, text_bytes, written

WINDOW = 10
#: Words of a piece of a long benchmark item.
PIECE_WORDS = 1 << 14
#: Benchmark text in one automaton; its words are at most half as many, so symbols fit in Unicode.
BLOCK_BYTES = 1 << 20
#: Bytes to lower-cased bytes; separators become spaces. Word bytes: 0-9, A-Z, a-z and all above 0x7F.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010FFFF]+")
_UNKNOWN = "\x00"

_STATE = T.StructType([T.StructField("_spans", T.ArrayType(T.IntegerType())), T.StructField("_items", T.ArrayType(T.StringType()))])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
    T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()),
    T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())]))),
])


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


def _symbol(k: int) -> str:
    return chr(k + 1 if k < 0xD7FE else k + 0x802)  # past the surrogates


def build_automaton(items: list[tuple[str | None, str | None]], window: int = WINDOW):
    """(word -> symbol, automaton or None) of benchmark items; a value is (length, ids of the items with that window)."""
    symbols: dict[bytes, str] = {}
    patterns: dict[str, set[str]] = {}
    for item_id, text in items:
        coded = "".join([symbols.setdefault(w, _symbol(len(symbols))) for w in normal_words(text)])
        for i in range(max(1, len(coded) - window + 1) if coded else 0):
            patterns.setdefault(coded[i:i + window], set()).update(() if item_id is None else (item_id,))
    automaton = ahocorasick.Automaton()
    for pattern, ids in patterns.items():
        automaton.add_word(pattern, (len(pattern), tuple(sorted(ids))))
    if patterns:
        automaton.make_automaton()
    return symbols, automaton if patterns else None


def scan(coded: str, automaton) -> tuple[list[int], set[str]]:
    """Merged word spans [start, end, start, end, ...] of all pattern occurrences, and the items that occur."""
    spans: list[int] = []
    items: set[str] = set()
    for last, (length, ids) in automaton.iter(coded):
        items.update(ids)
        start = last + 1 - length
        while spans and start <= spans[-2]:  # a longer pattern may end later and start earlier
            del spans[-2:]
        if spans and start <= spans[-1]:
            spans[-1] = last + 1
        else:
            spans += [start, last + 1]
    return spans, items


def merge_spans(spans: list[int]) -> list[int]:
    merged: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def _result(text: str, n_words: int, spans: list[int], items: list[str]) -> dict:
    hits = []
    if spans:
        at = np.array([m.span() for m in _ORIGINAL_WORD.finditer(text)])
        hits = [{"start_word": a, "end_word": b, "start_char": int(at[a, 0]), "end_char": int(at[b - 1, 1])} for a, b in zip(spans[::2], spans[1::2], strict=True)]
    return {"n_words": n_words, "n_hit": sum(spans[1::2]) - sum(spans[::2]), "n_items": len(items),
            "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), "contaminated": bool(spans), "hits": hits}


def item_pieces(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """(item, body): distinct pieces of at most ``PIECE_WORDS`` words of every item, each with the last window - 1 words of the one before, so that
    every window of an item is a window of a piece. An item of fewer words than a window is one piece."""
    step = max(1, PIECE_WORDS - window + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("item").to_pylist(), batch.column("body"), strict=True):
                words = normal_words(body.as_py())
                if words:
                    pieces = [b" ".join(words[i:i + step + window - 1]).decode() for i in range(0, max(1, len(words) - window + 1), step)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces), pa.string()), pa.array(pieces, pa.string())], names=["item", "body"])

    bench = pick(benchmark, item=item, body=text).select(F.col("item").cast("string"), "body").where(F.col("body").isNotNull())
    return bench.mapInArrow(run, "item string, body string").distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, then n_words, n_hit, n_items, items_sha256,
    contaminated and hits (merged spans in words and in characters of the original text).

    A benchmark of several blocks is one pass over the documents for each, which leaves only the row numbers, spans and items of rows
    that it hits; the documents are written once, with those numbers, and never again.

    Nulls and edges: a null or wordless text has no words and no hits; a null or wordless item has no
    window; an item of fewer than ``window`` words is one window; items that share an id, and repeated items, count once; an item without
    an id still hits words but is not listed; an item of any length is cut into overlapping pieces. An empty benchmark contaminates
    nothing. Repeated documents each keep their row; other columns of either table are ignored.
    """
    spark = docs.sparkSession
    bench = written(item_pieces(benchmark, window, item_id, item_text), "pieces")
    blocks = max(1, -(-text_bytes(bench, "body") // block_bytes))
    names = [f"c{i}" for i in range(len(carry))]
    nothing = [F.array().cast("array<int>").alias("_spans"), F.array().cast("array<string>").alias("_items")]
    frame = docs.select(*[docs[c].alias(n) for c, n in zip(carry, names, strict=True)], docs[text].alias("body"))
    kept = T.StructType(frame.schema.fields[:len(names)] + RESULT.fields)
    automaton = lambda own: spark.sparkContext.broadcast(build_automaton([tuple(r) for r in own.collect()], window))  # noqa: E731  at most about block_bytes of text
    if blocks == 1:
        found = frame.select("*", *nothing).mapInArrow(_scanner(automaton(bench), True, len(names)), kept)
    else:
        frame = written(frame.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        hits = None
        for block in range(blocks):
            table = automaton(bench.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == block))
            state = T.StructType([T.StructField("_row", T.LongType()), T.StructField("body", T.StringType()), *_STATE.fields])
            own = written(frame.select("_row", "body", *nothing).mapInArrow(_scanner(table, False, 1), state).where(F.size("_spans") > 0).select("_row", *_STATE.names), "hits")
            hits = own if hits is None else hits.union(own)
            table.destroy()
        merged = hits.groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
        joined = frame.join(merged, "_row", "left").select(*names, "body", *[F.coalesce(F.col(c), empty).alias(c) for c, empty in zip(_STATE.names, nothing, strict=True)])
        found = joined.mapInArrow(_scanner(spark.sparkContext.broadcast(({}, None)), True, len(names)), kept)
    return found.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], *RESULT.names)


def _scanner(table, last: bool, n_carried: int):
    result_type = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()),
        ("hits", pa.list_(pa.struct([("start_word", pa.int32()), ("end_word", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, automaton = table.value
        symbol = symbols.get
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, state = [], []
                for text, spans, items in zip(batch.column("body"), batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True):
                    body = text.as_py() or ""
                    found = normal_words(body)
                    if automaton is not None and found:
                        new, ids = scan("".join([symbol(w, _UNKNOWN) for w in found]), automaton)
                        if new:
                            spans, items = merge_spans(spans + new), sorted(ids.union(items))
                    elif spans:
                        spans, items = merge_spans(spans), sorted(items)
                    if last:
                        rows.append(_result(body, len(found), spans, items))
                    else:
                        state.append((spans, items))
                carried = batch.columns[:n_carried]
                if last:
                    out = pa.array(rows, result_type).flatten()
                else:
                    out = [batch.column("body"), pa.array([s for s, _ in state], pa.list_(pa.int32())), pa.array([i for _, i in state], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*carried, *out], names=[*batch.schema.names[:n_carried], *([f.name for f in result_type] if last else batch.schema.names[n_carried:])])

    return run
