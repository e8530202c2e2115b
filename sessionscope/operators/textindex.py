"""Indexed text search (P5, P7): a posting table of trigrams says which data files can hold a match.

``ILIKE '%q%'`` reads every row. The index holds, for every data file of a table, the distinct trigrams of a text column in lower case. A
text that matches a pattern holds every trigram of the pattern's literal parts, so only files with all of them are read, and
``ilike`` then decides row by row. A pattern without a literal of three characters prunes nothing.

The index may lag behind its table: a file that it does not know is read, and one that it knows but that is gone is not missed. So a
replace of a day needs no more than adding its new files (``add_to_index``), at any time.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionscope.session import path_exists

INDEX_SCHEMA = "file string, trigram string"
_FILE = "_metadata.file_path"


def literals(pattern: str) -> list[str]:
    """The parts of a LIKE pattern between its wildcards, in lower case; a backslash takes the next character as it is."""
    out, part = [], ""
    for token in re.findall(r"\\.|.", pattern, re.S):
        if token in ("%", "_"):
            out.append(part)
            part = ""
        else:
            part += token[-1]
    return [x for x in [*out, part] if x]


def trigrams_of(pattern: str) -> list[str]:
    """Trigrams that every text matching the pattern holds, in lower case. Only ASCII letters are lowered here: a literal with any other
    cased character is cut there, as the rules of other alphabets may change its length."""
    found: set[str] = set()
    for literal in literals(pattern):
        for part in re.split(r"[^\x00-\x7F]+", literal):
            part = part.lower()
            found.update(part[i:i + 3] for i in range(len(part) - 2))
    return sorted(found)


def _trigrams(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))


def add_to_index(table: DataFrame, column: str, index_path: str) -> int:
    """Index the files of ``table`` (a frame read from files) that the index does not know; returns how many there were.
    One row a file and distinct trigram: the pre-aggregation by file happens in the tasks that read it."""
    spark = table.sparkSession
    new = _unknown(spark, table, index_path)
    if new:
        rows = _of_files(table, new).where(F.length(column) >= 3)
        postings = rows.select(F.col(_FILE).alias("file"), F.explode(_trigrams(F.col(column))).alias("trigram")).distinct()
        every = rows.sparkSession.createDataFrame([(f, "") for f in new], INDEX_SCHEMA)   # so that a file without any text is known too
        postings.union(every).write.mode("append").parquet(index_path)
    return len(new)


def _same(file: str) -> str:
    """One spelling of a file's name: a scan lists ``file:///x`` where its metadata say ``file:/x``, percent-encoded."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(file))


def _index(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(index_path) if path_exists(spark, index_path) else spark.createDataFrame([], INDEX_SCHEMA)


def _unknown(spark: SparkSession, table: DataFrame, index_path: str) -> list[str]:
    known = {_same(r["file"]) for r in _index(spark, index_path).where("trigram = ''").select("file").collect()}    # one row a file
    return sorted(f for f in table.inputFiles() if _same(f) not in known)


def _of_files(table: DataFrame, files: list[str]) -> DataFrame:
    """The rows of some files of a partitioned table, with its columns."""
    base = table.inputFiles()[0] if not files else files[0]
    root = re.split(r"/[^/]+=[^/]*/", base)[0] if "=" in base else base.rsplit("/", 1)[0]
    return table.sparkSession.read.schema(table.schema).option("basePath", unquote(root)).parquet(*[unquote(f) for f in files])


def candidate_files(table: DataFrame, pattern: str, index_path: str) -> list[str]:
    """Files of ``table`` that can hold a match of ``%pattern%``: those with all its trigrams, and those not indexed."""
    spark, wanted, files = table.sparkSession, trigrams_of(pattern), sorted(table.inputFiles())
    if not wanted:
        return files
    index = _index(spark, index_path)
    held = index.where(F.col("trigram").isin(wanted)).groupBy("file").agg(F.count_distinct("trigram").alias("n")).where(F.col("n") == len(wanted))
    found = {_same(r["file"]) for r in held.select("file").collect()}    # file names, as the scan lists them
    unknown = set(_unknown(spark, table, index_path))
    return [f for f in files if _same(f) in found or f in unknown]


def search(table: DataFrame, column: str, pattern: str, index_path: str, where: list[Column] = ()) -> DataFrame:
    """Rows of ``table`` (read from files) whose ``column`` matches ``%pattern%`` as ``ilike`` does; further conditions may follow."""
    files = candidate_files(table, pattern, index_path)
    rows = _of_files(table, files) if files else table.limit(0)
    return reduce(lambda df, c: df.where(c), where, rows.where(F.col(column).ilike(f"%{pattern}%")))
