"""Language identification by rank-order profiles of character n-grams.

A profile is a text's PROFILE most frequent n-grams (1 to 3 letters, lower case, all else one
blank) in order.  Each language has one, from the counts over all learning texts.  A text gets
the language whose profile is least out of place: the sum over its n-grams of the difference in
rank, PROFILE for one that the language's profile lacks.

A letter is its whole code point: three of 21 bits fit one 64-bit number, and as no code is 0 an
n-gram's length shows in its number.  A text's counts are one sort.

Defined results: `und` with score 0 for a null text, one without a letter, or if nothing could be
learned; ties go to the language first in the alphabet; rows without lang aren't learned from;
repeated rows are learned as often as they come; an empty table gives an empty result; columns
besides those named are ignored; more than `LANGUAGES` different languages are an error, as a model
of them all would not be bounded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tilewright.llm.common import bucket_of, slices, small_batches, texts

PROFILE = 400
LANGUAGES = 10_000
_FLUSH = 1_000_000


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """For each code point 1 (blank) for a non-letter, else the code point + 1."""
    points = np.arange(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, points + 1, 1).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as numbers, and their counts; none if it has no letter."""
    codes = _codes()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.r_[1, codes, 1]
    x = codes[np.r_[True, (codes[1:] > 1) | (codes[:-1] > 1)]]
    if len(x) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    every = np.concatenate([x[x > 1], two, three])
    every.sort()
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[first], np.diff(np.r_[first, len(every)])


def letters(code: int) -> str:
    """An n-gram's number as text, a blank for each non-letter."""
    out = ""
    while code:
        point = (code & 0x1FFFFF) - 1
        out, code = (chr(point) if point else " ") + out, code >> 21
    return out


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The `size` most frequent n-grams, most frequent first, ties by code."""
    if len(codes) > 4 * size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    """Learned profiles: language -> n-grams in order."""

    def __init__(self, ranks: dict[str, np.ndarray], size: int = PROFILE):
        self.names = sorted(ranks)
        self.size = size
        self.codes = np.unique(np.concatenate([ranks[x] for x in self.names])) if ranks else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int32)
        for row, name in zip(self.ranks, self.names, strict=True):
            row[np.searchsorted(self.codes, ranks[name])] = np.arange(len(ranks[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - its distance / the largest distance possible)."""
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return "und", 0.0
        top = ranked(codes, counts, self.size)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at = np.where(self.codes[at] == top, at, len(self.codes))
        there = self.ranks[:, at]
        apart = np.where(there >= 0, np.abs(there - np.arange(len(top))), self.size).sum(axis=1)
        best = int(np.argmin(apart))
        return self.names[best], 1.0 - float(apart[best]) / (self.size * len(top))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return codes, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(codes)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language; what is held is added up, and given away where that is still too much."""
    held: defaultdict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = _merged(parts)
            name = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(codes), np.int64)))
            yield pa.RecordBatch.from_arrays([name, pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    for batch in small_batches(batches):
        for lang, text in zip(batch["lang"].to_pylist(), texts(batch["text"]), strict=True):
            found = grams(text)
            held[lang].append(found)
            size += len(found[0])
            if size > _FLUSH:
                for parts in held.values():
                    parts[:] = [_merged(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _FLUSH // 2:
                    yield from rows()
                    held.clear()
                    size = 0
    yield from rows()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows of docs with a language; what comes to the driver is size rows a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    if (several := docs.agg(F.approx_count_distinct(lang_col)).first()[0]) > LANGUAGES:
        raise ValueError(f"{several} different values are not languages")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).toPandas()
    return Profiles({str(lang): part.sort_values("rank")["code"].to_numpy(np.int64) for lang, part in top.groupby("lang")}, size)


def language_column(profiles: Profiles, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.arrow_udf(StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    def predict(array: pa.Array) -> pa.Array:
        got = [profiles.predict(x) for part in slices(array) for x in part.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents outside the fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held_out = bucket_of(F.col("doc_id"), folds) == fold
    profiles = learn(rows.where(~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), language_column(profiles, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
