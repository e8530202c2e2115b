"""Main-text extraction with a host suffix array.

Pages are parsed into blocks, and the contents of a host are brought together; pages with the same words are one content. The
word streams are concatenated and a suffix array is built by prefix doubling; neighbouring suffixes show which runs of
words repeat across distinct contents. A block is judged by the runs that tile it, from its first word to its last: it is
boilerplate only if every one of them repeats, so a block is kept or removed whole, and a text that differs in one word from another stays.

Outside article and main elements a block goes if contents of the host share all of its runs; if few do (two, or under a quarter of
them), it goes only where such blocks are at most a third of the page: a page more of which is shared with a few others is a near copy of
them, not boilerplate. Inside article and main, where the markup vouches for the text, a block goes only if most
of the host's contents have its runs, or show it as page furniture. Furniture elements (menus, footers, notices, adverts, forms,
comments) are never text.

A host with more than ``block_bytes`` of text is split by a hash of the content into blocks of about that size, so no task holds
a whole large host. Each block has its own suffix array and sends a hash of every distinct tiling run (one for ``min_run`` words) with the number of
its contents; the sums over the host decide, so the result does not depend on the split.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.llm import exchange as X
from sessionscope.llm.frames import written
from sessionscope.llm.markup import CHROME, CONTENT, PLAIN, blocks
from sessionscope.llm.urllists import host_of
from sessionscope.llm.words import mix, run_hashes, word_hashes

#: Words of a run that counts as repeated.
MIN_RUN = 6
BLOCK_BYTES = 1 << 20
#: Fewer pages than this say nothing about what most pages of a host show.
MIN_PAGES = 10
#: Hosts large enough to be split that may be broadcast at most; more are joined by shuffle.
MAX_SPLIT_HOSTS = 1_000_000
#: Repeated pages (distinct ones, and rows) that may be broadcast at most; more are joined by shuffle. Rows of one repeated page that meet in a task.
MAX_BROADCAST_COPIES = 100_000
COPIES_TOGETHER = 4096
_RUN_BASE = 0xD1342543DE82EF95
_COUNTS = "bucket int, host string, part int, pages long, h binary, n binary"
_CLASSES = "host string, part int, bucket int, found binary"


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each suffix in order, length of the common prefix of each with the one before it; 0 for the first)."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    levels, step = [rank], 1
    while rank.max(initial=0) < n - 1:
        later = np.zeros(n, np.int64)
        later[:max(n - step, 0)] = rank[step:] + 1
        _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        levels.append(rank)
        step *= 2
    order = np.argsort(rank)
    common = np.zeros(n, np.int64)
    i, j = order[1:].copy(), order[:-1].copy()
    for level in range(len(levels) - 2, -1, -1):
        inside = (i < n) & (j < n)
        same = np.zeros(len(i), bool)
        same[inside] = levels[level][i[inside]] == levels[level][j[inside]]
        i[same] += 1 << level
        j[same] += 1 << level
    common[1:] = i - order[1:]
    return order, common


def number_of(text: str, person: bytes = b"") -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8, person=person).digest(), "big")


def _parse(n_carried: int):
    """Per page: its blocks (a line each), their zones (a digit each), numbers of its words and of words and zones, bytes of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                pages = batch["html"].to_pylist()
                found = [blocks(x) for x in pages]
                body = ["\n".join(text for text, _ in b) for b in found]
                zones = ["".join(str(zone) for _, zone in b) for b in found]
                signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_pydict({
                    **{f"c{i}": batch[f"c{i}"] for i in range(n_carried)}, "row": batch["row"], "host": batch["host"], "body": pa.array(body, pa.string()), "zones": pa.array(zones, pa.string()),
                    "words": signed([number_of(b.replace("\n", " ")) for b in body]), "blocks": signed([number_of(f"{z}\n{b}") for z, b in zip(zones, body, strict=True)]),
                    "size": pa.array([len(b.encode()) for b in body], pa.int64())})
    return run


class _Page(NamedTuple):
    """Blocks of a table of pages: their zones, words, page, and the runs that tile those that are no furniture."""

    words: np.ndarray  # of all blocks that are no furniture
    offsets: np.ndarray
    content: np.ndarray  # number of each page's content
    blocks: list[list[tuple[str, int]]]
    tile: np.ndarray  # first word of every tiling run
    tile_page: np.ndarray
    tile_block: np.ndarray  # number of its block among all that are no furniture
    n_blocks: int


def _pages(table: pa.Table, min_run: int) -> _Page:
    pages = [list(zip(body.split("\n"), map(int, zones), strict=False)) for body, zones in zip(table["body"].to_pylist(), table["zones"].to_pylist(), strict=True)]
    words, offsets = word_hashes(pa.array([" ".join(text for text, zone in blocks if zone != CHROME) for blocks in pages], pa.string()))
    tile, tile_page, tile_block, number = [], [], [], 0
    for k, blocks in enumerate(pages):
        first, last = int(offsets[k]), int(offsets[k + 1])
        i = first
        for text, zone in blocks:
            if zone == CHROME:
                continue
            n = text.count(" ") + 1
            if n >= min_run:
                starts = [*range(i, i + n - min_run, min_run), i + n - min_run]
            else:  # too short for a run: the one that begins with it, or at the end of a page ends with it
                starts = [i] if i + min_run <= last else [i + n - min_run] if i + n - min_run >= first else []
            tile += starts
            tile_page += [k] * len(starts)
            tile_block += [number] * len(starts)
            number += 1
            i += n
    as_array = lambda x: np.array(x, np.int64)
    return _Page(words, offsets, np.unique(table["words"].to_numpy(), return_inverse=True)[1], pages, as_array(tile), as_array(tile_page), as_array(tile_block), number)


def counted_tiles(p: _Page, min_run: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct run at each tile, contents that have each as a tile), by the suffix array of the pages' words."""
    n = len(p.offsets) - 1
    tokens = np.insert(np.unique(p.words, return_inverse=True)[1].astype(np.int64), p.offsets[1:], -np.arange(n) - 1)
    row = np.repeat(np.arange(n), np.diff(p.offsets) + 1)
    order, common = suffix_array(tokens)
    at = order - row[order]
    inside = at + min_run <= p.offsets[1:][row[order]]
    run_at = np.full(len(p.words) + 1, -1)
    run_at[at[inside]] = (np.cumsum(common < min_run) - 1)[inside]
    run = np.unique(run_at[p.tile], return_inverse=True)[1]
    width = int(p.content.max(initial=0)) + 1
    pairs = np.unique(run * width + p.content[p.tile_page])
    return run, np.bincount(pairs // width)


ONE, FEW, SOME, MOST = 0, 1, 2, 3


def _verdict(count: np.ndarray, pages: np.ndarray | int) -> np.ndarray:
    """How many contents of the host have it: one; few (two, or under a quarter); some; most of them."""
    some, most = (count >= 3) & (4 * count >= pages), (count >= 2) & (2 * count > pages) & (np.asarray(pages) >= MIN_PAGES)
    return np.where(most, MOST, np.where(some, SOME, np.where(count >= 2, FEW, ONE))).astype(np.uint8)


def _furniture(p: _Page) -> dict[str, set[int]]:
    """The contents that show a block as page furniture, for every such block."""
    out: dict[str, set[int]] = {}
    for k, blocks in zip(p.content.tolist(), p.blocks, strict=True):
        for text, zone in blocks:
            if zone == CHROME:
                out.setdefault(text, set()).add(k)
    return out


def _salted(values: np.ndarray, table: pa.Table) -> np.ndarray:
    return mix(values ^ np.uint64(number_of(table["host"][0].as_py(), b"host")))


def _block_number(texts: list[str]) -> np.ndarray:
    return np.array([number_of(x, b"block") for x in texts], np.uint64)


def _hashes(p: _Page, min_run: int) -> np.ndarray:
    """Hash of the run at every tile."""
    return run_hashes(p.words, min_run, _RUN_BASE)[p.tile] if len(p.tile) else np.zeros(0, np.uint64)


def _send(buckets: int, min_run: int):
    """For one block of a split host: distinct tiling runs and furniture with the number of contents that have them."""
    def run(table: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        schema = pa.schema([("bucket", pa.int32()), ("host", pa.string()), ("part", pa.int32()), ("pages", pa.int64()), ("h", pa.binary()), ("n", pa.binary())])
        if not table.num_rows or table["parts"][0].as_py() < 2:
            return schema.empty_table()
        p = _pages(table, min_run)
        distinct, counts = counted_tiles(p, min_run)
        one = np.zeros(len(counts), np.int64)
        one[distinct] = np.arange(len(distinct))
        shown = _furniture(p)
        hashes, place = np.unique(_salted(np.r_[_hashes(p, min_run)[one], _block_number(list(shown))], table), return_inverse=True)
        total = np.zeros(len(hashes), np.int64)
        np.add.at(total, place, np.r_[counts, [len(x) for x in shown.values()]].astype(np.int64))
        sent = X.send_counts(0, hashes, total, buckets, 8)
        own = {c: pa.array([table[c][0].as_py()] * sent.num_rows, schema.field(c).type) for c in ("host", "part", "pages")}
        return pa.table([own[c] if c in own else sent[c] for c in names], schema=schema)
    return run


def _decide(table: pa.Table) -> pa.Table:
    """For one bucket: the verdict on every entry over its whole host, returned to its block."""
    hashes = [X.unplanes(x.as_py(), 8) for x in table["h"]]
    lengths = [len(x) for x in hashes]
    h = np.concatenate(hashes)
    n = np.concatenate([X.unplanes(x.as_py(), 4) for x in table["n"]]).astype(np.int64)
    pages = np.repeat(table["pages"].to_numpy(), lengths)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    found = np.empty(len(h), np.uint8)
    found[order] = np.repeat(_verdict(np.add.reduceat(n[order], first), pages[order][first]), np.diff(np.r_[first, len(h)]))
    ends = np.cumsum(lengths)
    return pa.table({"host": table["host"], "part": table["part"], "bucket": table["bucket"], "found": pa.array([found[e - k:e].tobytes() for e, k in zip(ends, lengths, strict=True)], pa.binary())})


def main_texts(table: pa.Table, answers: pa.Table | None, min_run: int = MIN_RUN) -> list[str]:
    """Main text of each page of a host, or of a block of a split host with the answers to what it sent."""
    p = _pages(table, min_run)
    shown = _furniture(p)
    if table["parts"][0].as_py() < 2:
        distinct, counts = counted_tiles(p, min_run)
        pages = int(p.content.max()) + 1
        verdict = _verdict(counts, pages)[distinct]
        furniture = dict(zip(shown, _verdict(np.array([len(x) for x in shown.values()], np.int64), pages).tolist(), strict=True))
    else:
        runs, texts = _salted(_hashes(p, min_run), table), _salted(_block_number(list(shown)), table)
        hashes, found = np.unique(np.r_[runs, texts]), X.received(answers)
        verdict = found[np.searchsorted(hashes, runs)]
        furniture = dict(zip(shown, found[np.searchsorted(hashes, texts)].tolist(), strict=True))
    judged = np.full(p.n_blocks, MOST, np.uint8)
    np.minimum.at(judged, p.tile_block, verdict)
    judged[np.setdiff1d(np.arange(p.n_blocks), p.tile_block)] = ONE
    out, of = [], iter(judged.tolist())
    for blocks in p.blocks:
        own = [(text, zone, text.count(" ") + 1, next(of)) for text, zone in blocks if zone != CHROME]
        shared = sum(n for _, zone, n, v in own if zone == PLAIN and v == FEW)
        near_copy = 3 * shared > sum(n for _, _, n, _ in own)
        kept = [text for text, zone, n, v in own if (zone == CONTENT and v < MOST and not (n + 2 >= min_run and furniture.get(text) == MOST))
                or (zone == PLAIN and (v == ONE or v == FEW and near_copy))]
        out.append("\n\n".join(kept))
    return out


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", carry: tuple[str, ...] = ("page_id", "url"), min_run: int = MIN_RUN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``carry`` columns, text and n_chars (code points) for every row of ``pages``.

    Nulls and edges: a null or empty html has empty text; pages without a valid URL are brought together as one host, split like
    any other; the only content of a host has no repeated run; pages of a host with the same words, whatever their URLs, are one
    content, and with the same blocks and zones get the same text (they are reduced to one before they are brought together); an empty table gives
    an empty result; other columns are ignored.
    """
    n = len(carry)
    carried = [T.StructField(f"c{i}", pages.schema[c].dataType) for i, c in enumerate(carry)]
    key = [T.StructField("host", T.StringType()), T.StructField("words", T.LongType()), T.StructField("blocks", T.LongType())]
    result = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    names = [f.name for f in key]
    base = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(host_of(pages[url]), F.lit("")).alias("host"), pages[html].alias("html"),
                        F.monotonically_increasing_id().alias("row"))
    number = T.StructField("row", T.LongType())
    parsed = base.mapInArrow(_parse(n), T.StructType([*carried, number, key[0], T.StructField("body", T.StringType()), T.StructField("zones", T.StringType()), *key[1:], T.StructField("size", T.LongType())]))
    mine = [f.name for f in carried]
    # pages are parsed twice, here for their numbers and below for their text: that is cheaper than writing the text
    numbers = written(parsed.select(*mine, "row", *names, "size"), "numbers", "zstd")
    keys = written(numbers.groupBy(*names).agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("row").alias("kept")), "keys")
    hosts = written(keys.groupBy("host", "words").agg(F.sum("size").alias("size")).groupBy("host").agg(F.sum("size").alias("size"), F.count("*").alias("pages")), "hosts")
    large = hosts.where(F.col("size") > block_bytes).select(F.col("host").alias("large"), F.ceil(F.col("size") / block_bytes).alias("parts"), "pages")
    n_large, split_bytes = large.agg(F.count("*"), F.sum("parts") * block_bytes).first()
    many = keys.where("n > 1").select(*names, "n", "kept")
    n_many, n_copies = many.agg(F.count("*"), F.sum("n")).first()
    rows = parsed.select(*mine, *names, "body", "zones", F.lit(0).cast("bigint").alias("n"))
    if n_many:  # of a repeated page the first row stands for all
        few = lambda keyed, size: F.broadcast(keyed) if size <= MAX_BROADCAST_COPIES else keyed
        one = parsed.join(few(many, n_many), names, "left").where("n is null or row = kept")
        rows = one.select(*[F.when(F.col("n").isNull(), F.col(f.name)).alias(f.name) for f in carried], *names, "body", "zones", F.coalesce("n", F.lit(0)).alias("n"))
    placed = (rows.join(F.broadcast(large) if n_large <= MAX_SPLIT_HOSTS else large, F.col("host") == F.col("large"), "left").drop("large")
              .withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod("words", "parts").cast("int")))
    by_block = placed.groupBy("host", "part")
    kept = [*carried, *key, T.StructField("n", T.LongType())]

    def finish(table: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        texts = main_texts(table, answers, min_run)
        return pa.table({**{f.name: table[f.name] for f in kept}, "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})

    schema = T.StructType([*kept, *result])
    if n_large:
        buckets = max(1, -(-int(split_bytes) // (6 * X.BUCKET_ENTRIES)))
        answers = by_block.applyInArrow(_send(buckets, min_run), _COUNTS).groupBy("bucket").applyInArrow(_decide, _CLASSES)
        out = by_block.cogroup(answers.groupBy("host", "part")).applyInArrow(lambda table, found: finish(table, found), schema)
    else:
        out = by_block.applyInArrow(lambda table: finish(table), schema)
    if n_many:  # a repeated page returns to all of its rows, dealt over as many keys as its rows need
        shares = F.greatest(F.ceil(F.col("n") / COPIES_TOGETHER), F.lit(1))
        copies = numbers.join(few(many, n_many), names).select(*[F.col(c).alias(f"own_{c}") for c in mine], *names, F.pmod("row", shares).alias("share"), F.lit(True).alias("copy"))
        out = (out.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1)))
               .join(few(copies, n_copies), [*names, "share"], "left").where("n = 0 or copy"))
        out = out.select(*[F.when(F.col("n") > 0, F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) for c in mine], "text", "n_chars")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "text", "n_chars")
