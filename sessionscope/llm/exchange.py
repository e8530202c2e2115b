"""Documents in bounded groups, and an exchange of hashed entries between groups and hash buckets.

A group is every document whose key hashes to it, in key order, so a task that is run again sees
the same block. A group sends each hash at most once (equal hashes within the group are settled
there), so no bucket receives more than one entry a group for any hash, however hot. Entries are
sent as packed columns of bytes; what a bucket finds out returns as one value an entry, in the
order in which the group sent them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.words import return_freed_memory

#: Text in one group; a single longer document makes a longer group.
GROUP_BYTES = 4 << 20
#: Entries that meet in one bucket, on average.
BUCKET_ENTRIES = 1 << 20


def grouped(docs: DataFrame, groups: int, doc_id: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    """Columns g, named (doc_id is not null), okey (doc_id, or a hash of the text where it is null), body, c0, c1, ..."""
    okey = F.coalesce(docs[doc_id].cast("bigint"), F.xxhash64(docs[text]))
    return docs.select(
        F.pmod(F.xxhash64(okey), F.lit(groups)).cast("int").alias("g"), docs[doc_id].isNotNull().alias("named"), okey.alias("okey"),
        docs[text].alias("body"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a group by document: those without an id first, then by id, then by text."""
    return table.take(pc.sort_indices(table, sort_keys=[("named", "ascending"), ("okey", "ascending"), ("body", "ascending")]))


def planes(values: np.ndarray, width: int, shift: int = 0) -> bytes:
    """Big-endian bytes of each value (the low ``width`` after ``shift``), byte position by byte position: sorted or small values compress well."""
    raw = (values.astype(np.uint64) >> np.uint64(shift)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return raw[:, 8 - width:].T.tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    return_freed_memory()
    n = len(blob) // width
    raw = np.zeros((n, 8), np.uint8)
    raw[:, 8 - width:] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return raw.reshape(-1).view(">u8").astype(np.uint64)


def cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """buckets+1 bounds into sorted hashes; a bucket is a range of the upper 32 bits."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


COUNTS_SCHEMA = "bucket int, g int, h binary, n binary"
CLASSES_SCHEMA = "g int, bucket int, found binary"


def send_counts(g: int, hashes: np.ndarray, counts: np.ndarray, buckets: int, width: int) -> pa.Table:
    """Rows of COUNTS_SCHEMA for a group's sorted distinct hashes; ``width`` bytes of a hash are sent."""
    at = cuts(hashes, buckets)
    rows = [(b, planes(hashes[i:j], width, 64 - 8 * width), planes(counts[i:j], 4)) for b, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "g": pa.array([g] * len(rows), pa.int32()),
                     "h": pa.array([r[1] for r in rows], pa.binary()), "n": pa.array([r[2] for r in rows], pa.binary())})


def total_classes(width: int):
    """For one bucket: floor(log2(total count)) of every entry, returned to its group."""
    def run(table: pa.Table) -> pa.Table:
        hashes = [unplanes(x.as_py(), width) for x in table["h"]]
        lengths = [len(x) for x in hashes]
        h = np.concatenate(hashes)
        n = np.concatenate([unplanes(x.as_py(), 4) for x in table["n"]])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        total = np.add.reduceat(n, first)
        found = np.empty(len(h), np.uint8)
        found[order] = np.repeat(np.log2(total.astype(np.float64)).astype(np.uint8), np.diff(np.r_[first, len(h)]))
        ends = np.cumsum(lengths)
        return pa.table({"g": table["g"], "bucket": table["bucket"], "found": pa.array([found[e - k:e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary())})
    return run


def received(answers: pa.Table, column: str = "found") -> np.ndarray:
    """A group's answers of all buckets, in the order in which it sent its entries."""
    if not answers.num_rows:
        return np.zeros(0, np.uint8)
    answers = answers.sort_by("bucket")
    return np.frombuffer(b"".join(x.as_py() for x in answers[column]), np.uint8)


def rebatched(table: pa.Table, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=rows)
