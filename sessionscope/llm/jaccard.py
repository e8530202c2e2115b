"""N-gram Jaccard join by vertical partitioning, and the groups its links form.

1. Global order: the document count of every shingle is taken over all documents (through the bucket exchange);
   shingles are ordered from rare to frequent, by class of count and then by hash. The 48-bit order key of a
   shingle is that class and its hash.
2. Two sets with a Jaccard similarity of at least t share a shingle among the first n - ceil(t n) + 1 of each, in
   that order. A shingle that only one document has cannot be shared, so a document whose prefix is full
   of those has no partner, and only shared shingles are kept of the rest.
3. Documents with equal sets become one class. Classes that share a prefix shingle are candidates.
4. The order is cut into fragments of about equal load. Partial overlaps of candidate pairs are counted in each
   fragment by itself, then summed for the pair; the sum decides the link, exactly.

Candidates are not all pairs of a shingle's classes. First every class is compared with one centre a shingle, the one that
shares the largest part of its set, and what links is joined: a pair a class and centre. What then remains are the shingles
whose classes lie in several components. Their classes are compared with those outside the largest component of
their centre, in blocks: a block counts its partial overlaps in each fragment as one matrix, the matrices
are summed, and only links between different components leave it. So every pair that shares a
prefix shingle is either in one component or counted, and the components are those of all links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm import exchange as X
from sessionscope.llm.components import components
from sessionscope.llm.frames import text_bytes, written
from sessionscope.llm.words import mix, row_of, run_hashes, word_hashes

SHINGLE = 5
#: Similarity threshold in hundredths.
SIMILARITY = 80
#: Ranges of the global order that are counted separately.
FRAGMENTS = 8
#: Classes on each side of a block of the second comparison.
BLOCK_CLASSES = 256
_COLUMNS = 4096
#: Keys of at most this many rows (24 bytes each) are broadcast.
BROADCAST_KEYS = 1_000_000
#: Candidate pairs that meet in one cell of a fragment, on average; hot centres are salted to the same bound.
CELL_PAIRS = 2000
_COUNT_BYTES = 5
_KEY_BYTES = 6
_BASE, _SIGN_A, _SIGN_B = 0x9FB21C651E98DF25, np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _sets(column: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingle hash, row) of every distinct shingle of every row, by hash and row; number of rows."""
    words, offsets = word_hashes(column, lower=True)
    count, row = np.diff(offsets), row_of(offsets)
    h = run_hashes(words, k, _BASE)
    r = row[:len(h)]
    at = np.flatnonzero(np.arange(len(h)) + k <= offsets[1:][r])
    hashes, rows = [h[at]], [r[at]]
    for size in range(1, k):  # a shorter text is one shingle
        short = np.flatnonzero(count == size)
        if len(short):
            hashes.append(run_hashes(words[(offsets[short][:, None] + np.arange(size)).ravel()], size, _BASE)[::size])
            rows.append(short)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((r, h)) if len(hashes) > 1 else np.argsort(h, kind="stable")
    h, r = h[order], r[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.zeros(0, bool)
    return h[new], r[new], len(count)


def _send_shingles(buckets: int, k: int):
    def run(table: pa.Table) -> pa.Table:
        h, _, _ = _sets(X.in_order(table)["body"], k)
        found, counts = np.unique(h, return_counts=True)
        return X.send_counts(table["g"][0].as_py(), found, counts, buckets, _COUNT_BYTES)
    return run


def _describe(k: int, similarity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("sign", pa.binary()), ("prefix", pa.list_(pa.int64())), ("shared", pa.binary())])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        table = X.in_order(table)
        h, row, rows = _sets(table["body"], k)
        _, entry = np.unique(h, return_inverse=True)
        level = X.received(answers)[entry] if len(h) else np.zeros(0, np.uint8)
        n = np.bincount(row, minlength=rows)
        with np.errstate(over="ignore"):
            signs = []
            for salt in (_SIGN_A, _SIGN_B):
                total = np.zeros(rows, np.uint64)
                np.add.at(total, row, mix(h ^ salt))
                signs.append(mix(total ^ n.astype(np.uint64)))
        prefix = n - (similarity * n + 99) // 100 + 1
        alone = np.bincount(row[level == 0], minlength=rows)
        active = (n > 0) & (alone < prefix)
        use = active[row] & (level > 0)
        key = (level[use].astype(np.uint64) << np.uint64(42)) | (h[use] >> np.uint64(22))
        owner = row[use]
        order = np.lexsort((key, owner))
        key, owner = key[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(rows + 1))
        prefixes, shared = [], []
        for i in range(rows):
            own = key[bounds[i]:bounds[i + 1]]
            prefixes.append(own[:prefix[i] - alone[i]].astype(np.int64) if active[i] else None)
            shared.append(X.planes(own, _KEY_BYTES) if active[i] else None)
        named = table["named"].combine_chunks()
        sign = np.stack(signs, 1).astype(">u8").tobytes()
        return pa.table([pa.compute.if_else(named, table["okey"].combine_chunks(), pa.scalar(None, pa.int64())), table["c0"].combine_chunks(), pa.array(n, pa.int64()),
                         pa.array([sign[16 * i:16 * i + 16] if n[i] else None for i in range(rows)], pa.binary()),
                         pa.array(prefixes, pa.list_(pa.int64())), pa.array(shared, pa.binary())], schema=schema)
    return run


def _pivots(classes: DataFrame, fragments: int) -> list[int]:
    """Bounds of the fragments in the global order, from counts of the upper bits of all shared keys (at most 2**12 rows)."""
    def count(batches):
        total = np.zeros(1 << 12, np.int64)
        for batch in batches:
            for blob in batch.column("shared"):
                total += np.bincount(X.unplanes(blob.as_py(), _KEY_BYTES) >> np.uint64(36), minlength=1 << 12)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bin", "n"])
    load = {r["bin"]: r["n"] for r in classes.select("shared").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total, seen, pivots = sum(load.values()), 0, []
    for b in sorted(load):
        if seen >= total * (len(pivots) + 1) / fragments:
            pivots.append(b << 36)
        seen += load[b]
    return pivots


def _fragments(rows: DataFrame, classes: DataFrame, pivots: list[int], schema: str) -> DataFrame:
    """Rows with a node -> one row for each fragment that holds a part of its set: fragment, the columns of ``schema``, part."""
    names = [c.split()[0] for c in schema.split(", ")]
    sets = classes.select(F.col("node").alias("_node"), "shared")
    found = rows.join(sets, F.col("node") == F.col("_node")).select(*names, "shared")

    def cut(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                fragment, source, part = [], [], []
                for i, blob in enumerate(batch.column("shared")):
                    keys = X.unplanes(blob.as_py(), _KEY_BYTES)
                    at = [0, *np.searchsorted(keys, np.array(pivots, np.uint64)), len(keys)]
                    for f, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                        if b > a:
                            fragment.append(f)
                            source.append(i)
                            part.append(X.planes(keys[a:b], _KEY_BYTES))
                carried = batch.take(pa.array(source, pa.int64())).columns[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(fragment, pa.int32()), *carried, pa.array(part, pa.binary())], names=["fragment", *names, "part"])
    return found.mapInArrow(cut, f"fragment int, {schema}, part binary")


def _count_partial(table: pa.Table) -> pa.Table:
    """Overlaps of one cell's pairs (node, centre) within one fragment. The centre's own row has it as node."""
    a, b = table["node"].to_pylist(), table["centre"].to_pylist()
    parts = [X.unplanes(x.as_py(), _KEY_BYTES) for x in table["part"]]
    own = {y: part for x, y, part in zip(a, b, parts, strict=True) if x == y}
    rows = []
    for x, y, part in zip(a, b, parts, strict=True):
        if x != y and y in own:
            at = np.minimum(np.searchsorted(own[y], part), len(own[y]) - 1)
            rows.append((x, y, int((own[y][at] == part).sum())))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "overlap"), columns, strict=True)})


def count_overlaps(pairs: DataFrame, cells: int, classes: DataFrame, pivots: list[int], cell_pairs: int = CELL_PAIRS) -> DataFrame:
    """(a, b, na, nb, overlap) of distinct pairs (a, b: node and centre) that share a shingle: partial overlaps a fragment, summed a pair."""
    members = pairs.groupBy("b").agg(F.count("*").alias("members"))
    salted = pairs.join(members, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / cell_pairs)).alias("salt"))
    placed = salted.select(F.pmod(F.xxhash64("b", "salt"), F.lit(cells)).alias("cell"), F.col("a").alias("node"), F.col("b").alias("centre"))
    rows = placed.union(placed.select("cell", F.col("centre").alias("node"), "centre").distinct())
    parts = _fragments(rows, classes, pivots, "cell long, node long, centre long")
    overlaps = parts.groupBy("fragment", "cell").applyInArrow(_count_partial, "a long, b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    size = classes.select("node", "n")
    return overlaps.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", "na", "nb", "overlap")


def _side(table: pa.Table, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    own = table.filter(pa.compute.equal(table["right"], right))
    return own["node"].to_numpy(), own["n"].to_numpy(), own["component"].to_numpy(), [X.unplanes(x.as_py(), _KEY_BYTES) for x in own["part"]]


_MATRIX = "centre long, s int, m int, left binary, right binary, overlap binary"


def _count_block(table: pa.Table) -> pa.Table:
    """Partial overlaps of one block within one fragment: the (node, n, component) of both sides and a matrix of counts."""
    (a, na, ca, pa_), (b, nb, cb, pb) = _side(table, False), _side(table, True)
    total = np.zeros((len(a), len(b)), np.int32)
    if len(a) and len(b):
        left, right = np.concatenate(pa_), np.concatenate(pb)
        shared = np.intersect1d(left, right)
        row_a, row_b = np.repeat(np.arange(len(a)), [len(x) for x in pa_]), np.repeat(np.arange(len(b)), [len(x) for x in pb])
        at_a, at_b = np.searchsorted(shared, left), np.searchsorted(shared, right)
        in_a, in_b = (at < len(shared) for at in (at_a, at_b))
        in_a[in_a] = shared[at_a[in_a]] == left[in_a]
        in_b[in_b] = shared[at_b[in_b]] == right[in_b]
        for start in range(0, len(shared), _COLUMNS):
            x, y = np.zeros((len(a), _COLUMNS), np.float32), np.zeros((len(b), _COLUMNS), np.float32)
            for grid, rows, at, use in ((x, row_a, at_a, in_a), (y, row_b, at_b, in_b)):
                own = use & (at >= start) & (at < start + _COLUMNS)
                grid[rows[own], at[own] - start] = 1
            total += (x @ y.T).astype(np.int32)
    first = table.slice(0, 1)
    return pa.table({"centre": first["centre"], "s": first["s"], "m": first["m"], "left": pa.array([np.stack([a, na, ca]).tobytes()], pa.binary()),
                     "right": pa.array([np.stack([b, nb, cb]).tobytes()], pa.binary()), "overlap": pa.array([total.tobytes()], pa.binary())})


def _link_block(similarity: int):
    """Sum the matrices of a block and return links that join different components, one for each join."""
    def run(table: pa.Table) -> pa.Table:
        sides = [[np.frombuffer(x.as_py(), np.int64).reshape(3, -1) for x in table[name]] for name in ("left", "right")]
        nodes = [np.unique(np.concatenate(side, 1), axis=1) for side in sides]  # sorted by node
        total = np.zeros((nodes[0].shape[1], nodes[1].shape[1]), np.int64)
        for left, right, blob in zip(*sides, table["overlap"], strict=True):
            at = [np.searchsorted(all_of[0], own[0]) for all_of, own in zip(nodes, (left, right), strict=True)]
            total[np.ix_(*at)] += np.frombuffer(blob.as_py(), np.int32).reshape(left.shape[1], right.shape[1])
        (a, na, ca), (b, nb, cb) = nodes
        linked = (100 * total >= similarity * (na[:, None] + nb[None, :] - total)) & (ca[:, None] != cb[None, :])
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                x = up
            return x
        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = root(int(ca[i])), root(int(cb[j]))
            if x != y:
                parent[x] = y
                out.append((int(a[i]), int(b[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})
    return run


def link_blocks(members: DataFrame, classes: DataFrame, pivots: list[int], similarity: int, size: int = BLOCK_CLASSES) -> DataFrame:
    """Links (a, b) between different components among the members (centre, node, n, component) of each centre: those outside the
    centre's largest component against all, block by block."""
    counted = members.groupBy("centre", "component").agg(F.count("*").alias("n"))
    largest = counted.groupBy("centre").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("total")).select(
        "centre", F.col("top.component").alias("major"), F.ceil((F.col("total") - F.col("top.n")) / size).cast("int").alias("ns"), F.ceil(F.col("total") / size).cast("int").alias("nm"))
    placed = members.join(largest.where("ns > 0"), "centre")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("component <> major").select("centre", own("ns").alias("s"), every("nm").alias("m"), F.lit(False).alias("right"), "node", "n", "component")
    right = placed.select("centre", every("ns").alias("s"), own("nm").alias("m"), F.lit(True).alias("right"), "node", "n", "component")
    parts = _fragments(left.union(right), classes, pivots, "centre long, s int, m int, right boolean, node long, n long, component long")
    return (parts.groupBy("fragment", "centre", "s", "m").applyInArrow(_count_block, _MATRIX)
            .groupBy("centre", "s", "m").applyInArrow(_link_block(similarity), "a long, b long"))


def _linked(overlaps: DataFrame, similarity: int) -> DataFrame:
    return overlaps.where(F.lit(100) * F.col("overlap") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("overlap")))


def link_groups(docs: DataFrame, k: int = SHINGLE, similarity: int = SIMILARITY, doc_id: str = "doc_id", text: str = "text", fragments: int = FRAGMENTS,
                group_bytes: int = X.GROUP_BYTES, bucket_entries: int = X.BUCKET_ENTRIES, block_classes: int = BLOCK_CLASSES) -> DataFrame:
    """For every row of ``docs``: doc_id, text_hash (xxhash64), n_shingles, component_id (the smallest doc_id reachable by links
    of similarity/100 or more), linked (whether its set can link at all) and first (whether it stands for its component: the
    row with the smallest id, then text_hash).

    Nulls and edges: a null or wordless text has an empty set, links with nothing and stands for itself; a text of fewer
    than ``k`` words is one shingle. A row without a doc_id takes part (its links connect others), gets the
    smallest id reachable, null if there is none, and comes after rows with an id. Rows that repeat, or share an
    id, are documents of their own that may link; exact repeats of a first row are all first. An empty table gives an
    empty result; other columns are ignored.
    """
    size = text_bytes(docs, text)
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // (6 * bucket_entries)))
    hashed = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("text_hash"))
    by_group = X.grouped(hashed, groups, "doc_id", "text", ("text_hash",)).groupBy("g")
    counted = (by_group.applyInArrow(_send_shingles(buckets, k), X.COUNTS_SCHEMA)
               .groupBy("bucket").applyInArrow(X.total_classes(_COUNT_BYTES), X.CLASSES_SCHEMA))
    described = written(by_group.cogroup(counted.groupBy("g")).applyInArrow(
        _describe(k, similarity), "doc_id long, text_hash long, n long, sign binary, prefix array<long>, shared binary"), "described")

    # one class a set; only classes whose prefix holds a shared shingle can link
    classes = written(described.where("shared is not null").dropDuplicates(["sign"]).select(
        "sign", "n", "prefix", "shared", (F.lit(1.0) - F.octet_length("shared") / _KEY_BYTES / F.col("n")).alias("loose"), F.monotonically_increasing_id().alias("node")), "classes")
    pivots = _pivots(classes, fragments)
    posts = classes.select("node", "n", "loose", F.explode("prefix").alias("shingle"))
    centres = (posts.groupBy("shingle").agg(F.min(F.struct("loose", F.xxhash64("node"), "node", "n")).alias("c"), F.count("*").alias("posts"))
               .where("posts > 1").select("shingle", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    posts = written(posts.join(centres, "shingle").select("shingle", "node", "n", "centre", "centre_n"), "posts")

    pairs = posts.where(F.col("node") != F.col("centre")).where(F.lit(100) * F.least("n", "centre_n") >= F.lit(similarity) * F.greatest("n", "centre_n"))
    pairs = written(pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "pairs")
    cells = max(1, -(-pairs.count() // CELL_PAIRS))
    links = written(_linked(count_overlaps(pairs, cells, classes, pivots), similarity).select("a", "b"), "links")
    labels = components(links)

    labelled = posts.join(labels, "node", "left").select("shingle", "centre", "node", "n", F.coalesce("component", "node").alias("component"))
    split = labelled.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("shingle")
    members = written(labelled.join(split, "shingle").select("centre", "node", "n", "component").distinct(), "members")
    more = written(link_blocks(members, classes, pivots, similarity, block_classes), "block-links")
    labels = components(links.union(more))

    member = classes.select("sign", "node").join(labels, "node", "left").select("sign", F.coalesce("component", "node").alias("component"))
    # a row without a set, and a set without a class, get a key of their own: no reducer receives all of them
    spread = F.encode(F.concat_ws("|", F.lit("none"), "doc_id", "text_hash"), "UTF-8")
    placed = described.select("doc_id", "text_hash", "n", "sign", F.coalesce("sign", spread).alias("key")).join(member.withColumnRenamed("sign", "key"), "key", "left")
    # a set without a partner is a component of its own: equal sets share their signature
    rows = placed.select("doc_id", "text_hash", "n", F.coalesce(F.col("component").cast("string"), F.hex("sign")).alias("own"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash").alias("rank"))
    rows = written(rows.select("doc_id", "text_hash", "n", "own", "rank", F.coalesce("own", F.hex(spread)).alias("key")), "placed")
    # written: the join then reads a plain exchange on either side, and a large component's rows are split
    least = written(rows.where("own is not null").groupBy("key").agg(F.min("rank").alias("least")), "least")
    return rows.join(least, "key", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.col("own").isNotNull().alias("linked"), (F.col("own").isNull() | (F.col("rank") == F.col("least"))).alias("first"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_keys: int = BROADCAST_KEYS, **options) -> DataFrame:
    """One row of every group of linked documents, with all columns of ``docs`` (their names may be any).

    The keys of rows that go are counted: up to ``broadcast_keys`` they are broadcast and the texts are not shuffled, beyond
    that both sides are. Exact repeats of a row that stays are cut to one by themselves.
    """
    bare = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    columns = {"doc_id": f"c{docs.columns.index(doc_id)}", "text": f"c{docs.columns.index(text)}"}
    found = written(link_groups(bare, **columns, **options).where("linked").select(
        F.coalesce("doc_id", "text_hash").alias("_okey"), F.col("doc_id").isNotNull().alias("_named"), F.col("text_hash").alias("_hash"), "first"), "firsts")
    key = ["_okey", "_named", "_hash"]
    again = found.where("first").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    gone = found.where("not first").select(*key).union(again).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)  # by position: no name of the caller is resolved again
    own_id, hashed = (plain[names[docs.columns.index(doc_id)]], F.xxhash64(plain[names[docs.columns.index(text)]]))
    keyed = plain.select(*names, F.coalesce(own_id, hashed).alias("_okey"), own_id.isNotNull().alias("_named"), hashed.alias("_hash"))
    small = F.broadcast if gone.count() <= broadcast_keys else (lambda keys: keys)
    kept = keyed.join(small(gone), key, "left_anti")
    if not again.isEmpty():
        kept = kept.union(keyed.join(small(again), key, "left_semi").dropDuplicates(key))
    return kept.select(*names).toDF(*docs.columns)
