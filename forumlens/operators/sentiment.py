"""Lexicon sentiment. Lexicons are arguments; the small ones here serve the registered queries and tests."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions.text import clamp, col


@dataclass(frozen=True)
class Lexicon:
    """Weights of phrases and words, and words that only lend a context. A word on both sides is negative."""

    negative_phrases: dict[str, float] = field(default_factory=dict)
    positive_phrases: dict[str, float] = field(default_factory=dict)
    negative_words: dict[str, float] = field(default_factory=dict)
    positive_words: dict[str, float] = field(default_factory=dict)
    context: tuple[str, ...] = ()


HOUSING = Lexicon(
    negative_phrases={"rent crisis": -0.8, "priced out": -0.7, "cannot afford": -0.7},
    positive_phrases={"first home": 0.4, "more supply": 0.5},
    negative_words={"crisis": -0.6, "eviction": -0.7, "unaffordable": -0.7, "stress": -0.5, "homeless": -0.7, "worse": -0.4},
    positive_words={"affordable": 0.5, "improve": 0.4, "support": 0.4, "relief": 0.5, "good": 0.3, "stress": 0.1},
    context=("rent", "mortgage", "housing", "landlord", "tenant", "lease", "bond"),
)


#: Phrases and words of a lexicon up to which each is an expression of the plan; a larger one is an automaton in the workers.
INLINE = 64


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-zA-Z']+"), F.lit(0))


def domain_score(text: Column | str, lex: Lexicon, words: Column | None = None) -> Column:
    """-1 to 1. A phrase counts once, wherever it stands; a word as often as it comes.

    Distinct context words push down by 0.06, 0.10 (three or more) or 0.15 (five or more). The sum is divided by the
    logarithm of the number of words; no words make 0. words: the text's words, where a column of `df` has them already,
    so that they are not looked for at each use. The score does not depend on the lexicon's size, but the plan of a small
    lexicon does (INLINE).
    """
    if len(lex.negative_phrases) + len(lex.positive_phrases) + len(lex.negative_words) + len(lex.positive_words) > INLINE:
        return by_automaton(text, lex, words)
    s = F.lower(F.coalesce(col(text), F.lit("")))
    words = words_of(text) if words is None else words
    phrases = [F.when(s.contains(p), F.lit(float(w))).otherwise(0.0) for p, w in {**lex.negative_phrases, **lex.positive_phrases}.items()]
    weights = {**lex.positive_words, **lex.negative_words}
    table = F.create_map(*[F.lit(x) for w, v in weights.items() for x in (w, float(v))]) if weights else F.create_map(F.lit(""), F.lit(0.0))
    by_word = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    hits = F.size(F.array_intersect(words, F.array(*map(F.lit, lex.context)))) if lex.context else F.lit(0)
    bias = F.when(hits >= 5, -0.15).when(hits >= 3, -0.10).when(hits >= 1, -0.06).otherwise(0.0)
    raw = sum(phrases, by_word) + bias
    n = F.size(words)
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp(raw / F.greatest(F.lit(1.0), F.ln(n + 1.0)), -1.0, 1.0))


class Automaton:
    """One walk over a text for all phrases (Aho-Corasick), one look-up a word: the work does not grow with the lexicon."""

    def __init__(self, lex: Lexicon):
        self.phrases = list({**lex.negative_phrases, **lex.positive_phrases}.items())
        self.words, self.context = {**lex.positive_words, **lex.negative_words}, frozenset(lex.context)
        # States of a trie over the phrases: where each letter leads to, the phrases that end there, and where to fall back.
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for n, (phrase, _) in enumerate(self.phrases):
            at = 0
            for c in phrase:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][c]
            self.ends[at].append(n)
        self.back, front = [0] * len(self.next), list(self.next[0].values())
        for at in front:
            for c, to in self.next[at].items():
                fall = self.back[at]
                while fall and c not in self.next[fall]:
                    fall = self.back[fall]
                self.back[to] = self.next[fall].get(c, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]
                front.append(to)

    def found(self, text: str) -> set[int]:
        """Numbers of the phrases that stand in the text."""
        out, at, start = set(self.ends[0]), 0, self.next[0]
        for c in text:
            if not at and c not in start:
                continue
            while at and c not in self.next[at]:
                at = self.back[at]
            at = self.next[at].get(c, 0)
            if self.ends[at]:
                out.update(self.ends[at])
        return out

    def raw(self, text: str, words: list[str]) -> float:
        """The sum that domain_score() scales, in the order of its additions."""
        total, found = 0.0, self.found(text)
        for w in words:
            total += self.words.get(w, 0.0)
        for n in sorted(found):
            total += float(self.phrases[n][1])
        hits = len(self.context.intersection(words))
        return total + (-0.15 if hits >= 5 else -0.10 if hits >= 3 else -0.06 if hits >= 1 else 0.0)


def by_automaton(text: Column | str, lex: Lexicon, words: Column | None = None) -> Column:
    """domain_score() of a lexicon of any size: the plan has one Arrow batch function, which holds the lexicon."""

    @F.pandas_udf("double")
    def raw(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Automaton(lex)
        for texts, lists in batches:
            yield pd.Series([known.raw(t, list(w)) for t, w in zip(texts, lists, strict=True)], dtype="float64")

    words = words_of(text) if words is None else words
    n = F.size(words)
    scaled = raw(F.lower(F.coalesce(col(text), F.lit(""))), words) / F.greatest(F.lit(1.0), F.ln(n + 1.0))
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp(scaled, -1.0, 1.0))


def blend(domain: Column, general: Column | None = None) -> Column:
    """0.65 domain and 0.35 general polarity; the other way round if the domain says nothing."""
    g = F.lit(0.0) if general is None else general
    return clamp(F.when(domain == 0, 0.35 * domain + 0.65 * g).otherwise(0.65 * domain + 0.35 * g), -1.0, 1.0)


def label(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 0.04, "positive").when(s <= -0.04, "negative").otherwise("neutral")


def attach(df: DataFrame, text: Column | str, lex: Lexicon = HOUSING, general: Column | None = None) -> DataFrame:
    """Adds sentiment, sentiment_label and subjectivity, rounded to four digits. general: a general polarity to blend in."""
    out = df.withColumn("_w", words_of(text)).withColumn("_d", domain_score(text, lex, F.col("_w"))).withColumn("sentiment", F.round(blend(F.col("_d"), general), 4))
    return out.withColumns({"sentiment_label": label("sentiment"), "subjectivity": F.round(F.least(F.lit(1.0), F.abs(F.col("_d")) + 0.15), 4)}).drop("_d", "_w")


def live_text(text: Column | str, strip_links: bool = True) -> Column:
    """Text as the live variants score it: lower case, hash signs as spaces; links and mentions go unless told not to."""
    s = F.lower(F.coalesce(col(text), F.lit("")))
    if strip_links:
        s = F.regexp_replace(F.regexp_replace(s, r"https?://[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+", " "), r"@[a-z0-9_.]+", " ")
    return F.replace(s, F.lit("#"), F.lit(" "))


def attach_live(df: DataFrame, text: Column | str, lex: Lexicon = HOUSING, strip_links: bool = True) -> DataFrame:
    """The live variant: the domain score alone; subjectivity is 0.15 at least where there are words."""
    clean = live_text(text, strip_links)
    out = df.withColumn("_c", clean).withColumn("_w", words_of("_c"))
    out = out.withColumn("_d", domain_score("_c", lex, F.col("_w"))).withColumn("_n", F.size("_w")).withColumn("sentiment", F.round("_d", 4))
    subjectivity = F.when(F.col("_n") > 0, F.least(F.lit(1.0), F.abs("_d") + 0.15)).otherwise(0.0)
    return out.withColumns({"sentiment_label": label("sentiment"), "subjectivity": F.round(subjectivity, 4)}).drop("_d", "_n", "_c", "_w")
