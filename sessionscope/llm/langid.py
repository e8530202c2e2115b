"""Language identification by multilingual mixture inference.

Training counts byte trigrams a language over the labelled documents, as one distributed aggregation. For a document,
expectation-maximisation estimates the proportion of each language in a set from the likelihoods of its trigrams. The
set grows one language at a time, by the steepest ascent of the likelihood, as long as the gain exceeds a
penalty for the added proportion; the largest proportion names the document.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionscope.llm.words import string_bytes

#: Trigrams are hashed to this many bits.
BITS = 16
SMOOTHING = 0.05
#: Penalty of one more language: this times the logarithm of the number of trigrams, three of which share a letter.
PENALTY = 1.5
EM_STEPS, EM_TOLERANCE = 60, 1e-5
UNDETERMINED = "und"

_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Hashed trigrams around every letter byte of a text: lower-cased, all that is neither an ASCII letter nor beyond ASCII as one separator."""
    if not len(raw):
        return np.zeros(0, np.uint32)
    b = _LETTER[raw]
    latin = np.flatnonzero((b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[:-1] == 0xC3)) + 1
    b[latin] += 0x20  # capital accented letters of the Latin-1 range
    b = np.r_[np.uint8(0), b, np.uint8(0)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))[b[1:-1] != 0]


def held_out(doc_id) -> "F.Column":
    """A third of the documents by id, left out of training; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        raw, at = string_bytes(batch.column("body"))
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            total[lang] += np.bincount(trigrams(raw[at[i]:at[i + 1]]), minlength=1 << BITS)
    for lang, counts in total.items():
        bins = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins, pa.int32()), pa.array(counts[bins])], names=["lang", "bin", "n"])


class Trigrams(NamedTuple):
    """Trigram probabilities of any number of languages: the counts that are not zero, by bin, and the total of each language."""

    start: np.ndarray
    lang: np.ndarray
    count: np.ndarray
    total: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.start) - 1, len(self.total)

    def __getitem__(self, bins: np.ndarray) -> np.ndarray:
        """Smoothed probabilities: a row a bin, a column a language."""
        out = np.full((len(bins), len(self.total)), SMOOTHING)
        size = self.start[bins + 1] - self.start[bins]
        at = np.arange(size.sum()) + np.repeat(self.start[bins] - np.cumsum(size) + size, size)
        out[np.repeat(np.arange(len(bins)), size), self.lang[at]] += self.count[at]
        return out / self.total

    def sum(self, axis: int = 0) -> np.ndarray:
        """Sums of the dense matrix that this stands for: over its bins (axis 0; 1 a language) or over its languages."""
        return self[np.arange(self.shape[0])].sum(axis)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], Trigrams]:
    """(languages in order of name, their trigram probabilities) from text and non-null lang
    of the documents that are not held out. All of those are counted; what reaches the driver, as Arrow columns, is the model alone:
    at most 2**BITS counts a language, and no more than its texts have distinct trigrams."""
    table = (docs.where(~held_out(docs[doc_id])).select(docs[text].alias("body"), docs[lang].alias("lang")).where("body is not null and lang is not null")
             .mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(table["lang"].to_pylist()))
    code = pc.index_in(table["lang"], value_set=pa.array(names, pa.string())).to_numpy().astype(np.int32)
    bins, n = table["bin"].to_numpy(), table["n"].to_numpy().astype(np.float64)
    order = np.lexsort((code, bins))
    total = np.bincount(code, n, minlength=len(names)) + SMOOTHING * (1 << BITS)
    return names, Trigrams(np.searchsorted(bins[order], np.arange((1 << BITS) + 1)), code[order], n[order], total)


def proportions(likelihood: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """Maximum-likelihood mixture proportions (expectation-maximisation) and their log-likelihood."""
    pi, total, before = start, counts.sum(), -np.inf
    for _ in range(EM_STEPS):
        mixed = likelihood @ pi
        now = float(counts @ np.log(mixed))
        if now - before < EM_TOLERANCE * total * 1e-2:
            break
        before = now
        pi = pi * (likelihood.T @ (counts / mixed)) / total
    return pi, now


def infer(grams: np.ndarray, p: Trigrams, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """Languages (columns of p) of a text in the order in which they were added, and their proportions."""
    bins, counts = np.unique(grams, return_counts=True)
    rows, counts = p[bins], counts.astype(np.float64)
    total = counts.sum()
    single = counts @ np.log(rows)
    chosen, pi, score = [int(np.argmax(single))], np.ones(1), float(single.max())
    cost = penalty * np.log(total)
    while len(chosen) < p.shape[1]:
        gain = (counts / (rows[:, chosen] @ pi)) @ rows / total  # over 1: adding the language raises the likelihood
        gain[chosen] = 0
        new = int(np.argmax(gain))
        if gain[new] <= 1 or total * np.log(gain[new]) <= cost:  # no mixture with one more language gains more than this
            break
        grown, value = proportions(rows[:, [*chosen, new]], counts, np.r_[pi * 0.9, 0.1])
        if value - score <= cost:
            break
        chosen, pi, score = [*chosen, new], grown, value
    return chosen, pi


def identify(docs: DataFrame, model: tuple[list[str], Trigrams], text: str = "text", carry: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY) -> DataFrame:
    """The ``carry`` columns, lang_pred, score (its proportion) and languages (lang, share; the whole selected set).

    Nulls and edges: a null text and one without a letter are ``und`` with score 0 and no languages, as is every
    text when nothing was learned. Equal likelihoods go to the language first by name. Rows are judged each by its
    own text, so repeated rows agree; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def run(batches):
        langs, p = shared.value
        for batch in batches:
            raw, at = string_bytes(batch.column("body"))
            out = []
            for i in range(batch.num_rows):
                body = raw[at[i]:at[i + 1]]
                grams = trigrams(body)
                if not langs or not len(grams) or not (((body | 32) - 97 < 26).any() or any(c.isalpha() for c in body.tobytes().decode())):
                    out.append({"lang_pred": UNDETERMINED, "score": 0.0, "languages": []})
                    continue
                chosen, pi = infer(grams, p, penalty)
                shares = sorted(zip(-pi, [langs[k] for k in chosen], strict=True))
                out.append({"lang_pred": shares[0][1], "score": float(min(1.0, -shares[0][0])), "languages": [{"lang": k, "share": float(-s)} for s, k in shares]})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *pa.array(out, result).flatten()], names=[*batch.schema.names[:-1], *[f.name for f in result]])

    schema = T.StructType([T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])))])
    frame = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs[text].alias("body"))
    return frame.mapInArrow(run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score", "languages")
