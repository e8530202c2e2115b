"""Substring deduplication with difference-cover anchors.

A window of ``length`` words is removed where the same words already start earlier. Anchors are
hashes of ``length - period + 1`` words, taken only at positions whose number in the document,
modulo the period, lies in a difference cover: for any two positions some shift below the period
puts both on the cover, so two equal windows always share an aligned anchor.

1. Each group of documents sends its distinct anchors; buckets answer which occur twice or more.
2. Windows that hold a repeated anchor are extended to their full length: each group sends one
   entry (96 bits of hash, document) a distinct window, and buckets answer whether an earlier
   document has it. Repeats within a group are settled there.
3. Removed windows are marked over the words of their documents, and the kept words rendered.

No pair of documents is ever formed; a hot passage costs one entry a group.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.llm import exchange as X
from sessionscope.llm.frames import text_bytes
from sessionscope.llm.words import mix, row_of, run_hashes, word_hashes

LENGTH = 20
#: A perfect difference cover modulo 13: every remainder is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR_BYTES = 6
_ANCHOR_BASE, _WINDOW_BASE, _SECOND_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xF1357AEA2E62A9C5
_SECOND = np.uint64(0x2545F4914F6CDD1D)

_ENTRIES = "bucket int, g int, kind int, h binary, h2 binary, okey binary, named binary, places binary, own binary"
_ANSWERS = "g int, kind int, bucket int, found binary, places binary, own binary"


def _anchors(words: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every anchor of the documents that have a window."""
    size = length - PERIOD + 1
    hashes = run_hashes(words, size, _ANCHOR_BASE)
    row = row_of(offsets)[:len(hashes)]
    start = np.arange(len(hashes)) - offsets[row]
    count = np.diff(offsets)[row]
    at = np.flatnonzero(np.isin(start % PERIOD, COVER) & (start + size <= count) & (count >= length))
    return at, hashes[at]


def _distinct(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """A group's documents in order, a repeated row (same id and text) once; and the document of every row."""
    table = X.in_order(table)
    okey, named = table["okey"].to_numpy(), table["named"].to_numpy()
    body = table["body"].combine_chunks()
    new = np.ones(len(okey), bool)
    for i in np.flatnonzero((okey[1:] == okey[:-1]) & (named[1:] == named[:-1])) + 1:
        new[i] = body[int(i)].as_py() != body[int(i) - 1].as_py()
    return table, new


def _send_anchors(buckets: int, length: int):
    def run(table: pa.Table) -> pa.Table:
        g = table["g"][0].as_py()
        table, new = _distinct(table)
        _, hashes = _anchors(*word_hashes(table.filter(pa.array(new))["body"]), length)
        found, counts = np.unique(hashes, return_counts=True)
        return X.send_counts(g, found, counts, buckets, ANCHOR_BYTES)
    return run


def _send_windows(buckets: int, length: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("kind", pa.int32()), *[(c, pa.binary()) for c in ("h", "h2", "okey", "named", "places", "own")]])
        if not table.num_rows:
            return schema.empty_table()
        g = table["g"][0].as_py()
        table, new = _distinct(table)
        table = table.filter(pa.array(new))
        words, offsets = word_hashes(table["body"])
        at, hashes = _anchors(words, offsets, length)
        _, entry = np.unique(hashes, return_inverse=True)
        repeated = X.received(answers)[entry] >= 1 if len(at) else np.zeros(0, bool)
        marks = np.zeros(len(words) + PERIOD + 1, np.int32)
        marks[at[repeated] + 1] = 1
        marks = np.cumsum(marks)
        ends = offsets[1:][row_of(offsets)] if len(words) else offsets[:0]
        starts = np.arange(len(words))
        starts = starts[(starts + length <= ends) & (marks[starts + PERIOD] > marks[starts])]
        if not len(starts):
            return schema.empty_table()
        h = run_hashes(words, length, _WINDOW_BASE)[starts]
        h2 = run_hashes(mix(words ^ _SECOND), length, _SECOND_BASE)[starts] >> np.uint64(32)
        order = np.lexsort((h2, h))  # stable: equal windows stay in document order
        h, h2, starts = h[order], h2[order], starts[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        own = np.sort(starts[~first])
        h, h2, starts = h[first], h2[first], starts[first]
        doc = row_of(offsets)[starts]
        okey, named = table["okey"].to_numpy()[doc].view(np.uint64), table["named"].to_numpy()[doc]
        cut = X.cuts(h, buckets)
        rows = [(b, g, 0, X.planes(h[i:j], 8), X.planes(h2[i:j], 4), X.planes(okey[i:j], 8), np.packbits(named[i:j]).tobytes(), None, None)
                for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
        rows.append((buckets + g, g, 1, None, None, None, None, X.planes(starts, 4), X.planes(np.diff(own, prepend=0), 4)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    return run


def _find_earlier(table: pa.Table) -> pa.Table:
    """For one bucket: 1 for every window that an earlier document has; a group's own notes pass through."""
    schema = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary()), ("places", pa.binary()), ("own", pa.binary())])
    if table["kind"][0].as_py() == 1:
        return pa.table([table["g"], table["kind"], table["bucket"], pa.nulls(table.num_rows, pa.binary()), table["places"], table["own"]], schema=schema)
    hashes = [X.unplanes(x.as_py(), 8) for x in table["h"]]
    lengths = [len(x) for x in hashes]
    h = np.concatenate(hashes)
    h2 = np.concatenate([X.unplanes(x.as_py(), 4) for x in table["h2"]])
    okey = np.concatenate([X.unplanes(x.as_py(), 8) for x in table["okey"]]).view(np.int64)
    named = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:k] for x, k in zip(table["named"], lengths, strict=True)])
    group = np.repeat(table["g"].to_numpy(), lengths)
    order = np.lexsort((group, okey, named, h2, h))
    found = np.empty(len(h), np.uint8)
    found[order] = np.r_[False, (h[order][1:] == h[order][:-1]) & (h2[order][1:] == h2[order][:-1])]
    ends = np.cumsum(lengths)
    none = pa.nulls(table.num_rows, pa.binary())
    return pa.table([table["g"], table["kind"], table["bucket"], pa.array([found[e - k:e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary()), none, none], schema=schema)


def _render(n_carried: int, length: int, with_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _result(table, [], [], [], [], n_carried, with_text)
        table, new = _distinct(table)
        split = [(x.as_py() or "").encode().split() for x in table["body"]]
        counts = np.array([len(x) for x in split])
        offsets = np.r_[0, np.cumsum(counts[new])]
        covered = np.zeros(offsets[-1] + 1, np.int32)
        notes = answers.filter(pa.compute.equal(answers["kind"], 1))
        if notes.num_rows:
            starts = X.unplanes(notes["places"][0].as_py(), 4).astype(np.int64)
            own = np.cumsum(X.unplanes(notes["own"][0].as_py(), 4).astype(np.int64))
            earlier = X.received(answers.filter(pa.compute.equal(answers["kind"], 0))).astype(bool)
            for places in (starts[earlier], own):
                np.add.at(covered, places, 1)
                np.add.at(covered, places + length, -1)
        gone = np.cumsum(covered)[:-1] > 0
        doc = np.cumsum(new) - 1
        removed, digests, texts = [], [], []
        for i, words in enumerate(split):
            mask = gone[offsets[doc[i]]:offsets[doc[i] + 1]]
            k = int(mask.sum())
            kept = b" ".join(compress(words, ~mask) if k else words)
            removed.append(k)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode() if k else table["body"][i].as_py())
        return _result(table, counts, removed, digests, texts, n_carried, with_text)
    return run


def _result(table: pa.Table, counts, removed, digests, texts, n_carried: int, with_text: bool) -> pa.Table:
    columns = {f"c{i}": table[f"c{i}"] for i in range(n_carried)}
    columns |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    return pa.table(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                   with_text: bool = True, group_bytes: int = X.GROUP_BYTES, bucket_entries: int = X.BUCKET_ENTRIES) -> DataFrame:
    """One row per row of ``docs``: the ``carry`` columns, n_words, n_removed, kept_sha256 (of the kept words joined
    by one space) and, on demand, kept_text (the text itself where no word is removed).

    Nulls and edges: a null text has no words (kept_text stays null); texts under ``length`` words keep all of them.
    Documents without an id come before all others, in the order of a hash of their text. Rows with the same id and
    text are one document given twice and get the same result; rows with the same id and other texts are ordered by
    text. Other columns are ignored, whatever their names.
    """
    if length < PERIOD + 1:
        raise ValueError(f"a window needs more than {PERIOD} words")
    size = text_bytes(docs, text)
    groups = max(1, -(-size // group_bytes))
    buckets = max(1, -(-size * len(COVER) // (6 * PERIOD * bucket_entries)))
    many = max(1, -(-size // (6 * bucket_entries)))
    frame = X.grouped(docs, groups, doc_id, text, carry)
    by_group = frame.groupBy("g")
    repeated = (by_group.applyInArrow(_send_anchors(buckets, length), X.COUNTS_SCHEMA)
                .groupBy("bucket").applyInArrow(X.total_classes(ANCHOR_BYTES), X.CLASSES_SCHEMA))
    earlier = (by_group.cogroup(repeated.groupBy("g")).applyInArrow(_send_windows(many, length), _ENTRIES)
               .groupBy("bucket").applyInArrow(_find_earlier, _ANSWERS))
    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
                          + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
                          + [T.StructField("kept_text", T.StringType())] * with_text)
    out = by_group.cogroup(earlier.groupBy("g")).applyInArrow(_render(len(carry), length, with_text), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *schema.names[len(carry):])
