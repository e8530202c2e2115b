"""Temporal list join for URL filters, in built-in functions only.

Dated list entries become validity intervals: an entry holds from its day until the next entry of the same pattern; a
removal ends it. Every capture is evaluated against the entries that are active on the day of its fetch, by an as-of join on
its URL, its host and the host's parent domains; the most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionscope.llm.frames import text_bytes, written

#: Patterns of up to this many bytes are broadcast, to drop keys that no entry has.
BROADCAST_BYTES = 8 << 20
#: Entries of one pattern and day: the first of these wins.
ACTIONS = ("block", "allow", "remove")
#: Longer host names are not valid in DNS; a URL with one has no host here.
MAX_HOST = 253


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when((host != "") & (F.length(host) <= MAX_HOST), host)


def intervals(entries: DataFrame, pattern: str = "pattern", action: str = "action", dated: str = "dated") -> DataFrame:
    """pattern, action, valid_from, valid_to (exclusive; null: still valid) of a list's history.

    A pattern is a host or domain (itself and everything below) or a whole URL. Entries of one pattern and day are merged
    first (block before allow before remove), so a pattern has one row a day, whatever the size of the list. Entries
    with a null, or with another action, say nothing.
    """
    rank = F.array_position(F.array(*[F.lit(a) for a in ACTIONS]), F.col("action"))
    daily = (entries.select(entries[pattern].alias("pattern"), entries[action].alias("action"), entries[dated].cast("date").alias("valid_from"))
             .where("pattern is not null and valid_from is not null").withColumn("rank", rank).where("rank > 0")
             .groupBy("pattern", "valid_from").agg(F.min("rank").alias("rank")))
    until = F.lead("valid_from").over(Window.partitionBy("pattern").orderBy("valid_from"))
    return daily.withColumn("valid_to", until).where(F.col("rank") < len(ACTIONS)).select("pattern", F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), F.col("rank").cast("int")).alias("action"), "valid_from", "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The ``keep`` columns, url, fetched (date), decision (block, allow, none), pattern and listed (the deciding entry and its day).

    Captures are first reduced to distinct (url, day), so a hot URL is evaluated once a day. Their keys (URL, host, parent domains) are
    dropped before the join unless they are patterns of the list, as long as the patterns fit ``BROADCAST_BYTES``.
    Nulls and edges: without URL, host or fetch time no domain entry applies (a whole-URL entry needs the URL and the
    time); repeated captures each keep their row; an empty list decides nothing; other columns are ignored.
    """
    rows = captures.select(*[captures[c].alias(f"c{i}") for i, c in enumerate(keep)], captures[url].alias("url"), captures[fetched].cast("date").alias("fetched"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = rows.where("url is not null and fetched is not null").select("url", "fetched").distinct().withColumn("host", host_of(F.col("url")))
    keys = asked.select("url", "fetched", F.explode(F.array_distinct(F.concat(F.array("url"), F.coalesce(parents, F.array().cast("array<string>"))))).alias("key"))
    # written: both sides of the join are then plain exchanges, whose hot keys Spark splits
    active = written(intervals(entries).toDF("key", "action", "valid_from", "valid_to"), "intervals")
    listed = written(active.select("key").distinct(), "patterns")
    if text_bytes(listed, "key") <= BROADCAST_BYTES:  # a top-level domain that is no pattern of the list does not reach the shuffle
        keys = keys.join(F.broadcast(listed), "key", "left_semi")
    hit = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    best = F.max(F.struct((F.col("key") == F.col("url")).alias("whole"), F.length("key").alias("length"), "key", "action", "valid_from"))
    decided = keys.join(active, "key").where(hit).groupBy("url", "fetched").agg(best.alias("best"))
    return rows.join(decided, ["url", "fetched"], "left").select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "url", "fetched", F.coalesce("best.action", F.lit("none")).alias("decision"),
        F.col("best.key").alias("pattern"), F.col("best.valid_from").alias("listed"))


def history_from_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures, list entries) that follow from a table of pages: a fetch day from the page id, and up to three dated entries
    for every host, one for the domain above it and one for every 17th URL, drawn from digests of the names."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    number = lambda x, part: F.conv(F.substr(F.md5(x), part * 7 + 1, F.lit(7)), 16, 10).cast("bigint")
    captures = pages.select("page_id", "url", day(F.pmod(F.col("page_id") * 37, F.lit(366))).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = F.array(*[F.lit(a) for a in ACTIONS])
    parts = hosts.select("host", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part"))
    above = F.regexp_replace("host", r"^[^.]*\.", "")
    listed = parts.select(F.when(F.col("part") < 3, F.col("host")).otherwise(above).alias("pattern"), F.when(F.col("part") < 3, number(F.col("host"), F.col("part"))).otherwise(number(above, F.lit(0))).alias("n"))
    single = pages.where("page_id % 17 = 0 and url is not null").select(F.col("url").alias("pattern"), number(F.col("url"), F.lit(0)).alias("n"))
    return captures, listed.union(single).select("pattern", F.element_at(names, (F.col("n") % 3 + 1).cast("int")).alias("action"), day(F.floor(F.col("n") / 3) % 366).alias("dated"))
