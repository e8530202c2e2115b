"""Trie of conversation prefixes from sorted conversations, without building a tree.

Distinct conversations are dealt out in sorted order; a block is one range of them. In a block, the lengths of the common
prefixes of neighbours go into a sparse table of range minima. A prefix belongs to a run of neighbours: each candidate finds the
first and the last one by its own binary search over the table, and its counts are differences of prefix sums over that run.
The candidates come in preorder, so a subtree is a range of them too.

A prefix whose run touches an end of its block may go on in the next one. Those are prefixes of the block's first and last
conversation, so two rows a block hold all of them; they are put together by the same search over these rows alone, in
one task (two conversations for every ``BLOCK_BYTES`` of them). All other prefixes are complete in their block.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.frames import pick, written

#: Bytes of a turn in a sequence: 16 of the SHA-256 of role and text, 4 of the text's length in code points.
WIDTH = 20
#: Sequences in one block; a single longer one makes a longer block.
BLOCK_BYTES = 8 << 20
#: Members whose ids are joined before they reach the task of their conversation's block.
CHUNK = 256
#: Rows that leave a task at once.
BATCH_ROWS = 1 << 15

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_BLOCKS = f"block int, slot long, {_NODE}, seq binary, parts binary"
_PART = np.dtype([("n", "<i8"), ("conv", "<i8"), ("kids", "<i8"), ("leaves", "<i8"), ("saved", "<i8"), ("chars", "<i8"), ("ends", "S64")])
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv long, seq binary) of every conversation: ``WIDTH`` bytes a turn, in the order of ``turn``.

    Nulls and edges: rows without an id belong to no conversation; a null turn comes first; a null role or text is empty. Turns of
    equal number are in the order of role, then text; repeated rows are repeated turns. Ids are whole numbers; other columns are
    ignored. Texts are hashed where they are read; only those of conversations with equal turn numbers are moved, to be sorted.
    """
    rows = pick(conversations, conv=conv_id, turn=turn, role=role, text=text).where("conv is not null").select(
        F.col("conv").cast("bigint").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.concat(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32),
                   F.lpad(F.hex(F.length("text").cast("bigint")), 8, "0"))

    def assembled(turns: DataFrame) -> DataFrame:
        ordered = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "place", "key"))).alias("turns"))
        return ordered.select("conv", F.unhex(F.array_join(F.col("turns.key"), "")).alias("seq"),
                              (F.size(F.array_distinct("turns.turn")) < F.size("turns")).alias("tied"))

    sequences = written(assembled(rows.select("conv", "turn", F.lit(0).alias("place"), key.alias("key"))), "sequences")
    tied = sequences.where("tied")
    if tied.isEmpty():
        return sequences.select("conv", "seq")
    place = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
    again = rows.join(tied.select("conv"), "conv", "left_semi").select("conv", "turn", place.alias("place"), key.alias("key"))
    return written(sequences.where("not tied").select("conv", "seq").union(assembled(again).select("conv", "seq")), "sequences")


def first_turns(seq: Column, n: Column | int) -> Column:
    return F.substring(seq, F.lit(1), F.lit(WIDTH) * n)


def later_turns(seq: Column, n: Column | int) -> Column:
    return F.substring(seq, F.lit(WIDTH) * n + 1, F.octet_length(seq))


class _Prefixes(NamedTuple):
    """Distinct prefixes of sorted distinct sequences, in preorder."""

    row: np.ndarray  # the first sequence that has it
    right: np.ndarray  # the last one
    depth: np.ndarray
    parent: np.ndarray  # place of the prefix that is one turn shorter; -1 for the root
    end: np.ndarray  # place after its subtree
    chars: np.ndarray  # length of its last text
    ends: np.ndarray  # whether it is that whole sequence


class _Sorted:
    """Sorted distinct sequences with a sparse table over the common prefixes of neighbours."""

    def __init__(self, seqs: list[bytes]):
        self.length = np.array([len(s) // WIDTH for s in seqs], np.int64)
        self.start = np.cumsum(self.length) - self.length
        turns = np.frombuffer(b"".join(seqs), np.uint8).reshape(-1, WIDTH)
        self.chars = np.ascontiguousarray(turns[:, 16:]).view(">u4").ravel().astype(np.int64)
        words = turns.view("<u4").reshape(-1, WIDTH // 4)
        both = np.minimum(self.length[1:], self.length[:-1])
        pair = np.repeat(np.arange(len(both)), both)
        depth = np.arange(len(pair)) - np.repeat(np.cumsum(both) - both, both)
        differ = np.flatnonzero((words[self.start[1:][pair] + depth] != words[self.start[:-1][pair] + depth]).any(1))
        at, first = np.unique(pair[differ], return_index=True)
        both[at] = depth[differ[first]]
        self.lcp = np.r_[-1, both]  # with the sequence before; the first one has nothing in common, not even the root
        self.table = _sparse(self.lcp)
        self.count = self.length - self.lcp  # prefixes that a sequence is the first to have
        self.offset = np.cumsum(self.count) - self.count

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First sequence of the run that shares the first ``depth`` turns of ``row``."""
        at = row.copy()
        for k in range(len(self.table) - 1, -1, -1):
            to = at - (1 << k)
            at = np.where((to >= 0) & (self.table[k][np.maximum(to + 1, 0)] >= depth), to, at)
        return at

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last sequence of that run."""
        at, last = row.copy(), len(self.length) - 1
        for k in range(len(self.table) - 1, -1, -1):
            to = at + (1 << k)
            inside = to <= last
            at = np.where(inside & (self.table[k][np.where(inside, at + 1, 0)] >= depth), to, at)
        return at

    def number(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Place in preorder of the prefix of ``row`` with ``depth`` turns."""
        first = self.left(row, depth)
        return self.offset[first] + depth - self.lcp[first] - 1

    def prefixes(self) -> _Prefixes:
        row = np.repeat(np.arange(len(self.length)), self.count)
        depth = np.arange(len(row)) - self.offset[row] + self.lcp[row] + 1
        right = self.right(row, depth)
        parent = np.full(len(row), -1)
        parent[1:] = self.number(row[1:], depth[1:] - 1)  # the root is the first
        chars = np.zeros(len(row), np.int64)
        chars[1:] = self.chars[self.start[row[1:]] + depth[1:] - 1]
        return _Prefixes(row, right, depth, parent, self.offset[right] + self.count[right], chars, depth == self.length[row])


def _sparse(values: np.ndarray) -> list[np.ndarray]:
    """Minima of every run of 1, 2, 4, ... values."""
    table = [values]
    while (half := 1 << (len(table) - 1)) * 2 <= len(values):
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    return table


def _least(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of values[first..last] for every pair, by two runs that cover it."""
    level = np.frexp(last - first + 1)[1] - 1
    out = np.empty(len(first), table[0].dtype)
    for k, row in enumerate(table):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[first[at]], row[last[at] - (1 << k) + 1])
    return out


def _within(values: np.ndarray, p: _Prefixes) -> np.ndarray:
    """Sum of a value over the subtree of every prefix."""
    sums = np.r_[0, np.cumsum(values)]
    return sums[p.end] - sums[:-1]


def _children(p: _Prefixes, counted: np.ndarray) -> np.ndarray:
    return np.bincount(p.parent[counted & (p.parent >= 0)], minlength=len(p.parent))


def _sent(columns: dict[str, object], names: list[str]):
    """Batches of the named columns; those that are not given are null."""
    n = len(next(iter(columns.values())))
    types = {"block": pa.int32(), "ends_sha256": pa.string(), "seq": pa.binary(), "parts": pa.binary()}
    for at in range(0, n, BATCH_ROWS):
        m = min(BATCH_ROWS, n - at)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, types.get(c, pa.int64())) if c not in columns else columns[c][at:at + m] if isinstance(columns[c], pa.Array)
                                          else pa.array(columns[c][at:at + m], types.get(c, pa.int64())) for c in names], names=names)


def _collect(batches) -> tuple[int, list[bytes], np.ndarray, np.ndarray, list[str]]:
    """One block: its number, distinct sequences, their members (how many, the smallest, the digest of all ids)."""
    block, seqs, n, first, ends, digest = 0, [], [], [], [], None
    for batch in batches:
        for b, seq, count, least, ids in zip(*[batch.column(c).to_pylist() for c in ("block", "seq", "n", "first", "ids")], strict=True):
            if seqs and seq == seqs[-1]:
                n[-1] += count
                first[-1] = min(first[-1], least)
                digest.update(b",")
            else:
                if digest is not None:
                    ends.append(digest.hexdigest())
                digest, block = hashlib.sha256(), b
                seqs.append(seq)
                n.append(count)
                first.append(least)
            digest.update(ids.encode())
    if digest is not None:
        ends.append(digest.hexdigest())
    return block, seqs, np.array(n, np.int64), np.array(first, np.int64), ends


def _block(batches):
    """Rows of ``_BLOCKS``: every prefix that is complete in the block (``slot`` where its parent is not), and the block's
    first and last sequence with what the block holds of each of their open prefixes (``slot`` 0 and 1; ``depth`` of the first)."""
    block, seqs, weight, first, digests = _collect(batches)
    if not seqs:
        return
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    p = _Sorted(seqs).prefixes()
    members = np.r_[0, np.cumsum(weight)]
    n = members[p.right + 1] - members[p.row]
    conv = _least(_sparse(first), p.row, p.right)
    is_open = (p.row == 0) | (p.right == len(seqs) - 1)
    kids = _children(p, ~is_open)
    saved = _within(np.where(is_open, 0, (n - 1) * p.chars), p)
    leaves = _within(~is_open & (kids == 0), p)
    digest = np.where(p.ends, np.array(digests, "S64")[p.row], b"")
    parts = np.zeros(len(n), _PART)
    for name, values in (("n", n), ("conv", conv), ("kids", kids), ("leaves", leaves), ("saved", saved), ("chars", p.chars), ("ends", digest)):
        parts[name] = values
    sides = [np.flatnonzero(p.row == 0)] + ([np.flatnonzero((p.row > 0) & (p.right == len(seqs) - 1))] if len(seqs) > 1 else [])
    yield from _sent({"block": [block] * len(sides), "slot": list(range(len(sides))), "depth": [int(p.depth[s[0]]) for s in sides],
                      "seq": [seqs[0], seqs[-1]][:len(sides)], "parts": [parts[s].tobytes() for s in sides]}, names)
    done = np.flatnonzero(~is_open)
    if len(done):
        above = p.parent[done]
        known = ~is_open[above]
        yield from _sent({"block": np.full(len(done), block), "slot": pa.array(2 * p.depth[above] + (p.row[above] > 0), mask=known),
                          "conv_id": conv[done], "depth": p.depth[done], "parent_conv_id": pa.array(conv[above], mask=~known),
                          "n_convs": n[done], "n_children": kids[done], "n_leaves": leaves[done], "saved_tokens": saved[done],
                          "ends_sha256": [d.decode() or _EMPTY for d in digest[done].tolist()]}, names)


def _open(batches):
    """Prefixes that are open in some block, from the first and last sequences of all blocks, sorted; and for each block which
    conversation stands for each of them (rows with ``block`` and ``slot``)."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    names = [f.split()[0] for f in f"block int, slot long, {_NODE}".split(", ")]
    seqs = _Sorted([r["seq"] for r in rows])
    p = seqs.prefixes()
    parts = [np.frombuffer(r["parts"], _PART) for r in rows]
    size = np.array([len(x) for x in parts])
    part, row = np.concatenate(parts), np.repeat(np.arange(len(rows)), size)
    depth = np.concatenate([np.arange(r["depth"], r["depth"] + len(x)) for r, x in zip(rows, parts, strict=True)])
    to = seqs.number(row, depth)
    total = {name: np.zeros(len(p.row), np.int64) for name in ("n", "kids", "leaves", "saved")}
    for name, values in total.items():
        np.add.at(values, to, part[name])
    conv = np.full(len(p.row), np.iinfo(np.int64).max)
    np.minimum.at(conv, to, part["conv"])
    digest = np.full(len(p.row), _EMPTY.encode(), "S64")
    ended = np.flatnonzero(part["ends"] != b"")
    digest[to[ended]] = part["ends"][ended]
    kids = total["kids"] + _children(p, np.ones(len(p.row), bool))
    yield from _sent({"conv_id": conv, "depth": p.depth, "parent_conv_id": [None, *conv[p.parent[1:]].tolist()], "n_convs": total["n"], "n_children": kids,
                      "n_leaves": total["leaves"] + _within(kids == 0, p), "saved_tokens": total["saved"] + _within((total["n"] - 1) * p.chars, p),
                      "ends_sha256": [d.decode() for d in digest.tolist()]}, names)
    side = np.array([r["slot"] for r in rows])
    yield from _sent({"block": np.array([r["block"] for r in rows])[row], "slot": 2 * depth + side[row], "conv_id": conv[to]}, names)


def prefix_nodes(sequences: DataFrame) -> DataFrame:
    """A row for every distinct prefix of the sequences (conv: unique whole numbers; seq: ``WIDTH`` bytes a turn), the empty
    one included: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Members of a prefix are the conversations that begin with it. n_leaves counts the childless prefixes of its subtree and saved_tokens
    adds up (members - 1) * length of the last text over it, itself included; ends_sha256 is the digest of the ids of the members
    that are the prefix itself, ascending, joined by commas.

    Nulls and edges: an empty sequence is a member of the root alone; equal sequences are one, with all their members; without
    conversations there is no row. Ids of equal sequences are joined in chunks of ``CHUNK`` numbers before they meet in the block of
    their sequence, which reads them one after another. The turns of one conversation are one row.
    """
    spark = sequences.sparkSession
    members = written(sequences.groupBy("seq", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("conv")).alias("convs")).select(
        "seq", "chunk", F.size("convs").cast("bigint").alias("n"), F.array_min("convs").alias("first"), F.array_join(F.col("convs").cast("array<string>"), ",").alias("ids")), "members")
    size = int(members.agg(F.sum(F.octet_length("seq"))).first()[0] or 0)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    parts = written(members.repartitionByRange(blocks, "seq").sortWithinPartitions("seq", "chunk").withColumn("block", F.spark_partition_id())
                    .mapInArrow(_block, _BLOCKS), "prefixes")
    ends = written(parts.where("seq is not null").select("block", "slot", "depth", "seq", "parts").repartition(1).sortWithinPartitions("seq")
                   .mapInArrow(_open, f"block int, slot long, {_NODE}"), "open-prefixes")
    columns = [f.split()[0] for f in _NODE.split(", ")]
    done = parts.where("seq is null")
    above = ends.where("block is not null").select("block", "slot", F.col("conv_id").alias("above"))
    below = done.where("slot is not null").join(above, ["block", "slot"]).select(*[F.col("above").alias(c) if c == "parent_conv_id" else c for c in columns])
    return done.where("slot is null").select(*columns).union(below).union(ends.where("block is null").select(*columns))
