"""Language identification by rank-order profiles.

A language's profile is the ranking of the most frequent n-grams of its training texts; a document is ranked alike, and
goes to the language whose profile is nearest by the out-of-place distance: the sum, over the document's ranked n-grams,
of how many places each is away from its place in the profile, or the length of a profile where it has none.

N-grams are of one to three characters of the text in lower case, in which every run of other characters than letters
is one space, as are the text's beginning and end; n-grams that are nothing but space don't count. Each is one 64-bit
number, 21 bits a character. A batch's n-grams are counted before they are shuffled, and a text is read in pieces, so that
neither a common language nor a long text makes a large task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.shared import scratch, text_or_empty, written

#: Ranks of a profile, and n-grams of a document that are compared at most: the most frequent ones of its whole text.
RANKS = 300
#: Characters of a text that are turned into numbers at a time.
PIECE = 1 << 20
#: Bound of the broadcast profiles: with more languages than this, fitting ends with an error.
MAX_LANGS = 2_000
UNDETERMINED = "und"
SPACE = 32


@cache
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    """The text's code points, with one space for each run of other characters than letters."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    codes = np.where(_letters()[codes], codes, SPACE)
    gap = codes == SPACE
    return codes[~(gap & np.concatenate(([False], gap[:-1])))]


def _grams(codes: np.ndarray, old: int) -> np.ndarray:
    """N-grams of one to three of `codes`, but for those that lie wholly within the first `old`."""
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    out = np.concatenate((codes[old:], two[max(old - 1, 0) :], three[max(old - 2, 0) :]))
    return out[out != SPACE]


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams ascending, their counts) of the whole text; empty if it has no letter."""
    text, found = text.lower(), (np.empty(0, np.int64), np.empty(0, np.int64))
    if not any(map(str.isalpha, text)):
        return found
    tail = np.array([SPACE], dtype=np.int64)
    for at in range(0, len(text), PIECE):
        codes = _codes(text[at : at + PIECE] + " " * (at + PIECE >= len(text)))
        codes = np.concatenate((tail, codes[int(codes[0] == SPACE == tail[-1]) :]))
        new = np.unique(_grams(codes, len(tail) if at else 0), return_counts=True)
        found = merged(*map(np.concatenate, zip(found, new, strict=True))) if at else new
        tail = codes[-2:]
    return found


def merged(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(grams, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, at most `most`, by count descending and then by number."""
    if len(grams) > most:
        floor = np.partition(counts, len(counts) - most)[len(counts) - most]
        grams, counts = grams[counts >= floor], counts[counts >= floor]
    return grams[np.argsort(-counts, kind="stable")][:most]


class Profiles:
    """Ranks of all profiles' n-grams, one column a language."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int) -> None:
        self.langs, self.ranks = sorted({r[0] for r in rows}), ranks
        self.grams = np.array(sorted({r[1] for r in rows}), dtype=np.int64)
        self.places = np.full((len(self.grams), len(self.langs)), -1, dtype=np.int32)
        column = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.places[np.searchsorted(self.grams, gram), column[lang]] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, 1 - distance as a part of the largest); of equal distances the smaller language."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        own = ranked(*count_grams(text), self.ranks)
        if not len(own):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = self.places[at[known]]
        off = np.where(places < 0, self.ranks, np.abs(places - np.flatnonzero(known)[:, None])).sum(axis=0) + (len(own) - known.sum()) * self.ranks
        best = int(np.argmin(off))
        return self.langs[best], 1.0 - float(off[best]) / (len(own) * self.ranks)


def fit_profiles(texts: DataFrame, ranks: int = RANKS, max_langs: int = MAX_LANGS) -> list[tuple[str, int, int]]:
    """(lang, n-gram, rank from 0), at most `ranks` a language, from all rows (text, lang) of which neither is null.

    Ties go to the smaller number. More than `max_langs` languages are an error, as profiles are sent to all workers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(count_grams(text))
            for lang, parts in found.items():
                grams, counts = merged(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    counted = texts.filter("text is not null and lang is not null").mapInArrow(count, "lang string, gram long, n long")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < ranks)
    with scratch(texts.sparkSession):
        top = written(top.select("lang", "gram", "rank"))
        if top.filter("rank = 0").count() > max_langs:
            raise ValueError(f"more than {max_langs} languages")
        return [tuple(r) for r in top.collect()]


def identify(docs: DataFrame, profiles: list[tuple[str, int, int]], text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """All rows and columns of `docs` plus lang_pred and lang_score (0 to 1), from the text alone.

    Null texts and texts without a letter are `und` with score 0, as is everything if no language was learned. Very long
    texts are read whole, and repeated rows come out as often as they come in. Columns of these two names in the input are
    replaced, whatever their case. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Profiles(sent.value, ranks)
        for batch in batches:
            yield pd.DataFrame([known.nearest(t) for t in batch], columns=["lang", "score"])

    out = docs.drop("lang_pred", "lang_score")
    names = list(out.columns)
    told = out.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), judge(F.col(f"`{text_col}`").cast("string")).alias("told"))
    return told.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("lang_score"))


def fold_of(id_col: str = "doc_id", folds: int = 3) -> Column:
    """The fold of a row: the CRC-32 of its id as text; a null id counts as empty."""
    return (F.crc32(text_or_empty(id_col).cast("binary")) % folds).cast("int")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ranks: int = RANKS) -> DataFrame:
    """identify() for all rows with profiles of those that are not held out, plus the boolean `held_out` (fold 1 of 3)."""
    out = docs.drop("held_out", "lang_pred", "lang_score")
    seen = out.filter(fold_of(id_col) != 1).select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    told = identify(out, fit_profiles(seen, ranks), text_col, ranks)
    return told.withColumn("held_out", fold_of(id_col) == 1)
