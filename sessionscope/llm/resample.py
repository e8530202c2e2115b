"""Importance resampling towards a target distribution, with exact ranks by parallel sorting by regular sampling.

A feature is a run of words, hashed to a bucket. The logarithm of the ratio of a bucket's shares in target and corpus is its
gain, kept in an array of a fixed number of buckets; a document's weight adds up the gains of its features, and hashed Gumbel noise
turns the highest scores into a weighted draw without replacement.

Ranking: every task sorts its run of rows; rows at regular distances in all runs give the splitters; rows go to the segment between
their splitters and meet there in order; the number of rows in the segments before it gives a segment its first rank.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.llm.frames import written
from sessionscope.llm.words import string_bytes

#: Text that is split into words at once; only a longer word makes a longer block.
BLOCK_BYTES = 1 << 20
#: Rows of a run and of a segment, as long as there are no more than MOST_RUNS of them: the square of that bounds the
#: regular samples, 16 bytes each, that the driver sorts.
RUN_ROWS, MOST_RUNS = 1 << 20, 1024

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LAST = (1 << 63) - 1


def features(raw: bytes, buckets: int, longest: int):
    """Blocks of (buckets of the runs of 1 to ``longest`` words, number of words) of a text in UTF-8."""
    text, at, tail = raw.translate(_WORD), 0, []
    while at < len(text):
        end = at + BLOCK_BYTES
        end = len(text) if end >= len(text) or (end := text.find(b" ", end)) < 0 else end
        words = tail + text[at:end].split()
        new = len(words) - len(tail)
        found = [words[len(tail):]] + [[b" ".join(words[i - k:i]) for i in range(max(k, len(tail) + 1), len(words) + 1)] for k in range(2, longest + 1)]
        yield np.concatenate([np.fromiter(map(crc32, runs), np.uint32, len(runs)) for runs in found]) % np.uint32(buckets), new
        tail = words[max(0, len(words) - longest + 1):] if longest > 1 else []
        at = end


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = 10000, longest: int = 1) -> np.ndarray:
    """Number of features of all texts in each bucket. Each task adds up its own texts; ``buckets`` numbers reach the driver."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, at = string_bytes(batch.column("body"))
            for i in range(batch.num_rows):
                for found, _ in features(raw[at[i]:at[i + 1]].tobytes(), buckets, longest):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select(texts[text].alias("body")).where("body is not null").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of shares) of each bucket, one feature added to every count."""
    b, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(t_base) / (float(s + 1) * float(s_base))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True) for t_base, s_base in [(s_all + b, t_all + b)]], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str, carry: tuple[str, ...], longest: int) -> DataFrame:
    """Columns c0, c1, ... (``carry``), n_words, n_features and weight (the sum of the gains of all features)."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        for batch in batches:
            raw, at = string_bytes(batch.column("body"))
            out = np.zeros((3, batch.num_rows), np.int64)
            for i in range(batch.num_rows):
                for found, n in features(raw[at[i]:at[i + 1]].tobytes(), len(gain), longest):
                    out[:, i] += (n, len(found), gain[found].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    return docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs[text].alias("body")).mapInArrow(run, schema)


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(1000 * Gumbel noise) at a hashed number of the id; a null id is hashed as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def rank_highest(rows: DataFrame, score: str, tie: str, n_rows: int, first: int) -> DataFrame:
    """``rows`` (a written table of ``n_rows`` rows; two whole-number columns) with ``rank``: 1, 2, 3, ... by descending score, then
    ascending tie, nulls last; null after the first ``first`` ranks. Rows equal in both have the ranks of their places in any order.

    Runs are the tasks that read the table, ``MOST_RUNS`` at most. A segment holds at most two runs' worth of rows and those
    equal to its splitter; segments that begin after ``first`` are not exchanged. Runs and segments are sorted by Spark, which spills.
    """
    spark = rows.sparkSession
    runs = min(MOST_RUNS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // RUN_ROWS)))
    step = max(1, n_rows // runs ** 2)
    keyed = rows.withColumn("_s", F.col(score).cast("bigint")).withColumn("_t", F.coalesce(F.col(tie).cast("bigint"), F.lit(_LAST)))
    sorted_runs = keyed.coalesce(runs).sortWithinPartitions(F.desc("_s"), "_t")

    def regular(batches):
        seen, s, t = 0, [], []
        for batch in batches:
            at = np.arange(-seen % step, batch.num_rows, step)
            s.append(batch.column("_s").to_numpy(zero_copy_only=False)[at])
            t.append(batch.column("_t").to_numpy(zero_copy_only=False)[at])
            seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).astype("<i8").tobytes()], pa.binary()) for x in (s, t)], names=["s", "t"])

    samples = sorted_runs.select("_s", "_t").mapInArrow(regular, "s binary, t binary").collect()
    s, t = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r[c], "<i8") for r in samples]]) for c in ("s", "t"))
    order = np.lexsort((t, -s))
    at = np.unique(np.arange(1, runs) * len(s) // runs)
    splitters = spark.sparkContext.broadcast((s[order][at[at < len(s)]], t[order][at[at < len(s)]]))

    def segment(batches):
        s, t = splitters.value
        for batch in batches:
            both = [np.r_[x, batch.column(c).to_numpy(zero_copy_only=False)] for x, c in ((s, "_s"), (t, "_t"))]
            order = np.lexsort((both[1], -both[0]))  # stable: a splitter comes before the rows equal to it
            out = np.empty(len(order), np.int32)
            out[order] = np.cumsum(order < len(s))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[len(s):])], names=[*batch.schema.names, "_segment"])

    dealt = written(keyed.mapInArrow(segment, T.StructType([*keyed.schema.fields, T.StructField("_segment", T.IntegerType())])), "segments")
    counts = dict(dealt.groupBy("_segment").count().collect())  # one number a segment
    begin, total = {}, 0
    for k in sorted(counts):
        begin[k], total = total, total + counts[k]
    needed = [k for k in begin if begin[k] < first]

    def ranks(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            k, where, n = np.unique(batch.column("_segment").to_numpy(zero_copy_only=False), return_index=True, return_counts=True)
            rank = np.concatenate([np.arange(m) + begin[i] + seen.get(i, 0) + 1 for i, m in zip(k.tolist(), n.tolist(), strict=True)]) if len(k) else np.zeros(0, np.int64)
            seen = {i: seen.get(i, 0) + m for i, m in zip(k.tolist(), n.tolist(), strict=True)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, mask=rank > first)], names=[*batch.schema.names, "rank"])

    merged = (dealt.where(F.col("_segment").isin(needed)).repartitionById(max(1, len(needed)), F.array_position(F.array(*map(F.lit, needed)), F.col("_segment")).cast("int") - 1)
              .sortWithinPartitions("_segment", F.desc("_s"), "_t").mapInArrow(ranks, T.StructType([*dealt.schema.fields, T.StructField("rank", T.LongType())])))
    rest = dealt.where(~F.col("_segment").isin(needed)).withColumn("rank", F.lit(None).cast("bigint"))
    return merged.union(rest).drop("_s", "_t", "_segment")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", carry: tuple[str, ...] = (),
             buckets: int = 10000, longest: int = 1, least_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document, and the ``carry`` columns: the ``percent`` of the documents of
    at least ``least_words`` words whose scores are highest have ranks 1, 2, 3, ..., all others a null rank.

    Words are runs of ASCII digits and letters, A-Z lower-cased, and of all characters beyond ASCII; features are runs of 1 to ``longest``
    words, joined by a space, repeats counted, hashed by CRC-32 modulo ``buckets``.

    Nulls and edges: a null or empty text has no words and weight 0. A null id is hashed as an empty text and ranks after all ids of
    the same score. Ids are whole numbers. Repeated rows are rows of their own: they share a score and have consecutive ranks.
    An empty target or an empty table of documents is counted as such; percent of few documents may be none. Columns other than those
    named are ignored, and carried ones may have any name but those of the result.
    """
    gains = bucket_gains(bucket_counts(docs, text, buckets, longest), bucket_counts(target, target_text, buckets, longest))
    weighed = weigh(docs, gains, text, (doc_id, *carry), longest)
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("c0"), seed)), "scored")
    n_rows = scored.where(F.col("n_words") >= least_words).count()
    ranked = rank_highest(scored.where(F.col("n_words") >= least_words), "score", "c0", n_rows, n_rows * percent // 100)
    other = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.union(other).select(F.col("c0").alias("doc_id"), "n_features", "weight", "score", "rank", *[F.col(f"c{i + 1}").alias(c) for i, c in enumerate(carry)])
