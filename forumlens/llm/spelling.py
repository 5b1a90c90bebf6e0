"""Spelling variants: words that one inserted, deleted or replaced letter makes of another, and the form that they stand for.

Candidates come from a positional q-gram inverted index. Postings list words by q-gram and place; those of a word's own
q-grams, at the same place or one beside it, are merged from a heap, and a partner must be met often enough: one edit
destroys at most q of the longer word's q-grams, so two words of m and n letters share at least max(m, n) + 1 - 2q.
What passes is verified.

The index is dealt over tasks by what an edit leaves alone. Within a pair whose shorter word has L letters, the edit is in the
first or in the second half of that word, so that the pair shares the other half and meets in that half's cell. A cell
that is too large is halved in the same way, into words that share what is around a smaller window, until it fits; the smallest
window, of one letter, can hold no more words than an alphabet makes. So no pair is lost, no cell is unbounded, and each
cell's index needs the q-grams about its window only: those beyond are shared by all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.shared import lower_ascii, scratch, text_or_empty, written

#: Letters of a shortest word and its least number of occurrences.
MIN_LENGTH, MIN_COUNT = 6, 5
#: One run in so many loses a letter.
DAMAGE = 199
#: A form is a near word that is so many times as frequent.
TIMES = 5
Q = 2
#: Letters of all words of a cell together, beyond which it is halved.
CELL = 8_192


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, one in `damage` of which has lost a letter.

    Shorter runs than `min_length` make no word and aren't cut out at all. Which run loses which letter is told by the
    CRC-32 of the id and the run, so that equal runs of a document fare alike; a null id counts as empty.
    """
    runs = F.regexp_extract_all(text_or_empty(text_col), F.lit(rf"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))
    each = docs.select(text_or_empty(id_col).alias("id"), F.explode(runs).alias("run"))
    word = each.select("id", lower_ascii(F.col("run")).alias("word"))
    if damage:
        word = word.withColumn("h", F.crc32(F.concat_ws(":", "id", "word").cast("binary")))
        at = F.pmod("h", F.char_length("word"))
        less = F.concat(F.substring("word", F.lit(1), at.cast("int")), F.substring("word", (at + 2).cast("int"), F.char_length("word")))
        word = word.select(F.when(F.col("h") % damage == 0, less).otherwise(F.col("word")).alias("word"))
    counts = word.groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.char_length("word") >= min_length) & (F.col("n") >= min_count))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    at = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) < 2 and a != b and a[at + (len(a) == len(b)) :] == b[at + 1 :]


def near_in_cell(words: list[str], shortest: int, low: int, high: int, q: int = Q) -> Iterator[tuple[int, int]]:
    """Places of the pairs of near words of which the shorter has `shortest` letters.

    All words have `shortest` letters or one more, and all are equal before the window [low, high) and after it, which is
    counted from the end. The window's q-grams are those that hold a letter of it or, for insertions, straddle it.
    """
    index: dict[tuple[str, int], list[int]] = defaultdict(list)
    for at, word in enumerate(words):
        padded = "\0" * (q - 1) + word + "\1" * (q - 1)
        wide = len(word) - shortest + high - low
        grams = [padded[k : k + q] for k in range(low, low + wide + q - 1)]
        posts = [index[g, p] for k, g in enumerate(grams) for p in (k - 1, k, k + 1) if (g, p) in index]
        # Of the q-grams of the window one edit leaves all but q; where it may leave none, all words are candidates.
        merged = groupby(merge(*posts)) if high - low > 1 else ((k, [k] * q) for k in range(at))
        for other, met in merged:
            longer = max(len(word), len(words[other]))
            if min(len(word), len(words[other])) == shortest and sum(1 for _ in met) >= longer - shortest + high - low - 1 and one_edit(word, words[other]):
                yield other, at
        for k, g in enumerate(grams):
            index[g, k].append(at)


def _cells(words: DataFrame, min_length: int, cell: int) -> DataFrame:
    """(shortest, low, high, words), a row for each cell of two words or more; a cell's words have at most `cell` letters
    together, or the window has one letter."""
    length = F.char_length("word")
    open_ = words.select("word", F.explode(F.array(length, length - 1)).alias("shortest")).filter(F.col("shortest") >= min_length)
    open_ = open_.select("word", "shortest", F.lit(0).alias("low"), F.col("shortest").alias("high"))
    key = F.xxhash64("shortest", "low", "high", F.expr("substring(word, 1, low)"), F.expr("substring(word, char_length(word) - shortest + high + 1)"))
    settled = None
    while not open_.isEmpty():
        half = F.expr("(low + high) div 2")
        ways = F.array(F.struct(F.col("low").alias("low"), half.alias("high")), F.struct(half.alias("low"), F.col("high").alias("high")))
        halves = open_.select("word", "shortest", F.explode(ways).alias("w")).select("word", "shortest", "w.low", "w.high").withColumn("cell", key)
        sizes = halves.groupBy("cell").agg(F.count("*").alias("n"), F.sum(length).alias("size")).filter("n > 1")
        sized = written(halves.join(sizes, "cell"))
        fits = (F.col("size") <= cell) | (F.col("high") - F.col("low") <= 1)
        done = sized.filter(fits).select("word", "shortest", "low", "high", "cell")
        settled = done if settled is None else settled.union(done)
        open_ = sized.filter(~fits).select("word", "shortest", "low", "high")
    if settled is None:
        return words.sparkSession.createDataFrame([], "shortest int, low int, high int, words array<string>")
    return settled.groupBy("cell", "shortest", "low", "high").agg(F.collect_list("word").alias("words")).drop("cell")


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, q: int = Q, cell: int = CELL) -> DataFrame:
    """(a, b), each pair of near words of the column `word` once, in either order; words are distinct."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = list(near_in_cell(row["words"], row["shortest"], row["low"], row["high"], q))
                yield pa.RecordBatch.from_pydict({"a": pa.array([row["words"][i] for i, _ in found], pa.string()), "b": pa.array([row["words"][j] for _, j in found], pa.string())})

    pairs = _cells(words.select("word"), min_length, cell).mapInArrow(find, "a string, b string")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int | None = DAMAGE, times: int = TIMES, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row for each word of word_counts().

    form: the near word of largest n (of equal ones the smallest in code-point order), if its n is at least `times` that of
    the word; root: where forms lead to in the end, the word itself if it has none. Null and empty texts have no words, very
    long ones are read whole, repeated rows count each, and an empty table gives an empty result. Other columns are not
    read, so that their names cannot clash.
    """
    with scratch(docs.sparkSession) as keep:
        words = written(word_counts(docs, id_col, text_col, min_length, min_count, damage))
        pairs = near_words(words, min_length, cell=cell)
        ways = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("word", "near")
        known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
        best = ways.join(known, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        named = words.join(best, "word", "left")
        has = -F.col("best.less") >= F.col("n") * times
        named = written(named.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")))
        # Each step of a way to the root is `times` as frequent, and each round doubles the steps: few rounds do.
        up = written(named.filter("form is not null").select("word", F.col("form").alias("root")))
        while not up.join(up.select(F.col("word").alias("root")), "root", "left_semi").isEmpty():
            far = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
            up = written(up.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root")))
        return keep(named.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
