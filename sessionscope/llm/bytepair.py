"""Byte-level byte-pair encoding by a segment tree over byte positions, and decoding.

The leaf of a byte position holds the rank of the pair that starts there, an inner node the least rank below it, the leftmost
one among equals; so the root names the next merge. A merge moves one live token, and its leaf, its left neighbour's and the
one that disappears are point updates of logarithmic cost. Short pieces are merged together, one tree a row of an array; a
long piece has a tree of its own. Texts are split, looked up and merged block by block, so memory does not grow with a text.
"""

from __future__ import annotations

import base64
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.llm.words import string_bytes

#: Text that is split and looked up at once.
BLOCK_BYTES = 2 << 20
#: Pieces of up to this many bytes are merged together; leaves of all their trees at once.
SHORT, LEAVES = 64, 1 << 19
#: Encoded pieces that a task remembers; beyond it, it forgets them all.
REMEMBERED = 1 << 18
NONE = np.int64(1) << np.int64(62)


class Vocabulary(NamedTuple):
    """Bytes of every id, and the id that each mergeable pair of ids becomes (pairs as left * 2**32 + right, ascending)."""

    tokens: list[bytes]
    pairs: np.ndarray
    merged: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a rank file: a line a token, its bytes in base64 and its rank. Read by the driver; its size bounds what is sent."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    found = []
    for token, rank in ranks.items():
        tokens[rank] = token
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                found.append((left << 32 | right, rank))
    table = np.array(sorted(found), np.int64).reshape(-1, 2)
    return Vocabulary(tokens, table[:, 0].copy(), table[:, 1].copy())


def merge_short(pieces: list[bytes], first: np.ndarray, pairs: np.ndarray, merged: np.ndarray) -> list[bytes]:
    """Ids (little-endian, 4 bytes each) of pieces of at most ``SHORT`` bytes; ``first`` is the id of every single byte."""
    lengths = np.array([len(p) for p in pieces])
    out: list[bytes] = [b""] * len(pieces)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        size = 1 << max(0, int(lengths[order[at]] - 1).bit_length())
        end = min(int(np.searchsorted(lengths[order], size, "right")), at + max(1, LEAVES // size))
        chosen = order[at:end]
        at = end
        n, rows = lengths[chosen], len(chosen)
        width = size + 1  # one place beyond the last byte
        raw = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in chosen.tolist()]), np.uint8).reshape(rows, width)
        token = first[raw]
        place = np.arange(width)
        after = np.minimum(place + 1, n[:, None])
        before = np.broadcast_to(place - 1, (rows, width)).copy()

        def keys(left: np.ndarray, right: np.ndarray, where: np.ndarray, size: int = size) -> np.ndarray:
            """Rank and place of a pair in one number; ``NONE`` where it has no rank."""
            pair = (left << 32) | right
            i = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            return np.where(pairs[i] == pair, merged[i] * size + where, NONE)

        tree = np.full((rows, 2 * size), NONE)
        live = place[:-1] + 1 < n[:, None]
        tree[:, size:][live] = keys(token[:, :-1][live], token[:, 1:][live], np.broadcast_to(place[:-1], (rows, size))[live])
        for node in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        gone = np.zeros((rows, width), bool)
        gone[place >= n[:, None]] = True

        def update(row: np.ndarray, leaf: np.ndarray, key, size: int = size, tree: np.ndarray = tree) -> None:
            node = leaf + size
            tree[row, node] = key
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            rank, here = np.divmod(tree[row, 1], size)
            right = after[row, here]
            beyond = after[row, right]
            token[row, here] = rank
            after[row, here] = beyond
            before[row, beyond] = here
            gone[row, right] = True
            update(row, right, NONE)
            ends = beyond >= n[row]
            update(row, here, np.where(ends, NONE, keys(rank, token[row, beyond], here)))
            some = np.flatnonzero(here > 0)
            left = before[row[some], here[some]]
            update(row[some], left, keys(token[row[some], left], rank[some], left))
            row = row[tree[row, 1] < NONE]
        kept = ~gone
        ids = token[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(1)).tolist()
        for i, a, b in zip(chosen.tolist(), [0, *ends], ends):
            out[i] = ids[4 * a:4 * b]
    return out


def merge_long(piece: bytes, first: np.ndarray, merges: dict[int, int]) -> bytes:
    """Ids of one piece of any length (little-endian, 4 bytes each)."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none = int(NONE)
    token = first[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def key(left: int, right: int) -> int:
        rank = merges.get(token[left] << 32 | token[right])
        return none if rank is None else rank * size + left

    tree = [none] * (2 * size)
    tree[size:size + n - 1] = [key(i, i + 1) for i in range(n - 1)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(leaf: int, value: int) -> None:
        node = leaf + size
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

    while tree[1] < none:
        rank, here = divmod(tree[1], size)
        right = after[here]
        beyond = after[right] if right < n else n
        token[here], token[right] = rank, -1
        after[here] = beyond
        update(right, none)
        if beyond < n:
            before[beyond] = here
            update(here, key(here, beyond))
        else:
            update(here, none)
        if before[here] >= 0:
            update(before[here], key(before[here], here))
    return np.array([t for t in token if t >= 0], "<u4").tobytes()


class _Encoder:
    """Ids of pieces, for one task."""

    def __init__(self, vocabulary: Vocabulary):
        tokens, self.pairs, self.merged = vocabulary
        if not len(self.pairs):
            self.pairs, self.merged = np.array([-1]), np.array([0])
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        self.first = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.lacks = set(np.flatnonzero(self.first < 0).tolist())
        self.merges: dict[int, int] | None = None
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> None:
        """Have the ids of these pieces in ``known``."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        short: list[tuple[str, bytes]] = []
        for piece in set(pieces).difference(self.known):
            raw = piece.encode()
            if (whole := self.whole.get(raw)) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif self.lacks and self.lacks.intersection(raw):
                raise ValueError("the vocabulary lacks a byte of the text")
            elif len(raw) <= SHORT:
                short.append((piece, raw))
            else:
                if self.merges is None:
                    self.merges = dict(zip(self.pairs.tolist(), self.merged.tolist(), strict=True))
                self.known[piece] = merge_long(raw, self.first, self.merges)
        self.known.update(zip([s[0] for s in short], merge_short([s[1] for s in short], self.first, self.pairs, self.merged), strict=True))


def encode(docs: DataFrame, vocabulary: Vocabulary, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``ids``: the token ids of the whole text as binary, little-endian unsigned 32-bit integers.

    Every match of ``pattern`` is encoded for itself: a piece that is a token is that token, any other is merged from its bytes,
    the pair of least rank first and the leftmost of equals. Text between matches has no ids. There are no special tokens.

    Nulls and edges: a null or empty text has no ids (an empty binary). Rows are encoded each by its own text, so repeated rows
    agree. Carried columns keep their names and types, other columns are ignored. A text is split block by block, so its length is
    bounded only by Spark's own limit on a value. A vocabulary without some byte of a text raises ValueError.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the rank file

    def run(batches):
        split, encoder = regex.compile(pattern), _Encoder(shared.value)

        def blocks(body: str):
            found = split.finditer(body)
            while pieces := [m.group() for m in islice(found, BLOCK_BYTES // 8)]:
                encoder.learn(pieces)
                yield b"".join(map(encoder.known.__getitem__, pieces))

        for batch in batches:
            raw, at = string_bytes(batch.column("body"))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(at, at[start] + BLOCK_BYTES, "right")) - 1)
                if end == start + 1:
                    out = [b"".join(blocks(raw[at[start]:at[end]].tobytes().decode()))]
                else:
                    pieces = [split.findall(raw[at[i]:at[i + 1]].tobytes().decode()) for i in range(start, end)]
                    encoder.learn([p for row in pieces for p in row])
                    out = [b"".join(map(encoder.known.__getitem__, row)) for row in pieces]
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "ids"])
                start = end

    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField("ids", T.BinaryType())])
    frame = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs[text].alias("body"))
    return frame.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "ids")


def n_tokens(ids: Column) -> Column:
    """Number of ids in a binary of them."""
    return F.shiftright(F.octet_length(ids).cast("bigint"), 2)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded`` and ``decoded``: the bytes of its ids, joined (binary, as ids of other origin may be no UTF-8).

    Nulls and edges: a null or empty ``ids`` gives an empty binary; an id that the vocabulary lacks raises. A column named
    ``decoded`` is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    names = [f for f in encoded.columns if f != "decoded"]

    def run(batches):
        token = shared.value.tokens
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("body")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
            for block in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
                if len(block):
                    part = batch.slice(int(block[0]), len(block))
                    out = [b"".join(map(token.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in part.column("body")]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    body = names.index(ids)
    masked = encoded.select(*[encoded[c].alias("body" if i == body else f"c{i}") for i, c in enumerate(names)])
    schema = T.StructType([*masked.schema.fields, T.StructField("decoded", T.BinaryType())])
    return masked.mapInArrow(run, schema).toDF(*names, "decoded")
