"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the output over its share of the corpus. Each document draws how
often it appears by inverting the Poisson distribution of that mean at a number hashed from the seed and the document, so
a draw depends on nothing else and is the same in every run. A large mean is split into equal parts, each drawn at a number of its
own: their sum is a Poisson draw of the whole mean. Documents are exploded by their count and
ordered globally by a hash of seed, document and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.frames import written

#: Means above this are drawn in parts: the inversion adds probabilities from exp(-mean) on, which must not vanish.
MAX_MEAN = 500
#: A table of rates up to this many sources is broadcast (under 10 MB); a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) of 52 bits, hashed from the seed and a key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """Smallest k whose cumulative Poisson probability reaches u; the sum ends far beyond any u of 52 bits."""
    far = F.ceil(mean + F.lit(12) * F.sqrt(mean) + F.lit(40)).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.when(s["c"] >= u, s).otherwise(F.struct(p.alias("p"), (s["c"] + p).alias("c"), k.alias("k")))

    return F.when(mean <= 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), far), start, step, lambda s: s["k"]))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, size: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """source, mean: expected copies of each document. A source's target share is its weight (missing: 0), or without weights
    its characters to the ``power``; the output is expected to have ``size`` times the corpus's characters."""
    mass = docs.groupBy(docs[source].alias("source")).agg(F.sum(F.length(F.coalesce(docs[text], F.lit("")))).alias("mass"))
    if weights is None:
        share = F.sqrt(F.col("mass").cast("double")) if power == 0.5 else F.pow(F.col("mass").cast("double"), F.lit(power))
    else:
        if any(w < 0 for w in weights.values()) or not any(weights.values()):
            raise ValueError("weights must not be negative, and not all be zero")
        share = F.lit(0.0)
        for name, weight in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(share)
    shared = written(mass.select("source", "mass", F.when(F.col("mass") > 0, share).otherwise(F.lit(0.0)).alias("share")), "shares")
    total = shared.agg(F.sum("mass").alias("mass"), F.sum("share").alias("share")).first()
    scale = size * (total["mass"] or 0) / total["share"] if total["share"] else 0.0
    return shared.select("source", F.when(F.col("mass") > 0, F.col("share") * F.lit(scale) / F.col("mass")).otherwise(F.lit(0.0)).alias("mean"))


def _many_copies(drawn: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Copies of documents whose mean is above MAX_MEAN, spread over rows of at most MAX_MEAN copies before they are exploded."""
    parts = F.ceil(F.col("mean") / MAX_MEAN)
    numbers = F.transform(F.sequence(F.lit(1).cast("bigint"), parts), lambda k: uniform(F.concat(F.lit("part|"), k.cast("string"), F.lit("|"), F.col("key")), seed))
    total = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda n, u: n + poisson(F.col("mean") / parts, u))
    counted = drawn.select(*columns, "key", total.alias("n")).where("n > 0")
    spread = counted.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"), F.lit(MAX_MEAN).cast("bigint"))).alias("start")).repartition("key", "start")
    copies = spread.select(*columns, "key", F.explode(F.sequence(F.col("start"), F.least("n", F.col("start") + (MAX_MEAN - 1)))).alias("copy"))
    return copies.withColumn("copy", F.col("copy").cast("int"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = 0.5, size: float = 1.0, seed: int = 11, doc_id: str = "doc_id", source: str = "source", text: str = "text", max_mean: float | None = None) -> DataFrame:
    """All columns of ``docs`` (their names may be any) with copy (1, 2, ...) and shuffle_key (long), one row a copy, in global random order.

    A column of ``docs`` named copy or shuffle_key gives way to the new one.
    Nulls and edges: documents without a source form one source; one without an id draws by its text; repeated rows draw alike;
    a source without characters has mean 0; an empty table gives an empty result. Every mean is drawn, however small a source is beside
    the others; only a caller that gives ``weights`` and ``max_mean`` asks for means above it to raise.
    """
    given = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    columns = [f"c{i}" for i in range(len(given))]
    named = dict(zip(docs.columns, [f"d{i}" for i in range(len(docs.columns))], strict=True))
    plain = docs.toDF(*named.values())  # by position: no name of the caller is ever resolved
    own_id, own_source, own_text = (plain[named[c]] for c in (doc_id, source, text))
    means = rates(plain, weights, power, size, named[source], named[text])
    top = means.agg(F.max("mean"), F.count("*")).first()
    largest = top[0] or 0
    if weights is not None and max_mean is not None and largest > max_mean:
        raise ValueError(f"a source would be repeated {largest:.0f} times on average; max_mean is {max_mean}")
    key = F.coalesce(own_id.cast("string"), F.md5(F.coalesce(own_text, F.lit(""))))
    rows = plain.select(*[plain[named[c]].alias(k) for c, k in zip(given, columns, strict=True)], key.alias("key"), own_source.alias("own"), own_id.alias("id"))
    carried = [*columns, "id"]
    drawn = rows.join(F.broadcast(means) if top[1] <= BROADCAST_SOURCES else means, F.col("own").eqNullSafe(F.col("source")), "left")
    few = drawn.where(F.col("mean") <= MAX_MEAN) if largest > MAX_MEAN else drawn
    few = few.withColumn("n", poisson(F.col("mean"), uniform(F.col("key"), seed))).where("n > 0")
    copies = few.select(*carried, "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    if largest > MAX_MEAN:
        copies = copies.unionByName(_many_copies(drawn.where(F.col("mean") > MAX_MEAN), carried, seed))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("copy").cast("string"), F.lit("|"), F.col("key"))), 1, 15), 16, 10).cast("bigint")
    return copies.select(*columns, "copy", order.alias("shuffle_key"), "id").orderBy("shuffle_key", "id").drop("id").toDF(*given, "copy", "shuffle_key")
