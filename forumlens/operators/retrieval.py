"""The parts of hybrid retrieval: gate, BM25, hashed dense vectors, rank fusion and lexical reranking.

operators.inverted puts them together for many questions at once; here each is by itself, for one question.

A query has few terms, so nothing is exploded to count them: term frequencies are conditional counts inside each row,
and corpus size, document frequencies and average length are one aggregation. Only the documents that pass the gate
are exploded, for the norms of their dense vectors.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.text import tokenize

K1, B, RRF_K, DIMENSIONS = 1.5, 0.75, 60, 128
STOPWORDS = frozenset("a an and are as at be by for from how in is it of on or the to was what with".split())


def tokens_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def important_terms(query: str, stopwords: frozenset[str] = STOPWORDS) -> list[str]:
    return sorted({t for t in tokens_of(query) if t not in stopwords and len(t) > 2})


def corpus_df(df: DataFrame, corpus: str, text: str) -> DataFrame:
    """(corpus, term, df): in how many documents of a corpus each term stands."""
    terms = df.select(corpus, F.explode(F.array_distinct(tokenize(text))).alias("term"))
    return terms.groupBy(corpus, "term").agg(F.count("*").alias("df"))


def with_tokens(df: DataFrame, text: Column | str) -> DataFrame:
    return df.withColumn("_tokens", tokenize(text))


def gate(df: DataFrame, query: str, stopwords: frozenset[str] = STOPWORDS) -> DataFrame:
    """Documents that share an important term with the query: one of over two letters that is no stopword.

    Without important terms all pass; if no document shares any, all pass when there is one important term, and none
    when there are more.
    """
    need = important_terms(query, stopwords)
    if not need:
        return df
    hit = F.arrays_overlap("_tokens", F.array(*map(F.lit, need)))
    if len(need) > 1:
        return df.filter(hit)
    any_hit = df.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_hit)).filter(hit | ~F.col("_any")).drop("_any")  # one row


def count_of(tokens: str, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def _score(base: DataFrame, query: str, id_col: str, k1: float) -> DataFrame:
    """(id, bm25) of rows with their tokens and the one row of statistics: _n, _avg, and document frequencies by term."""
    terms = tokens_of(query)
    names = {t: f"_t{i}" for i, t in enumerate(dict.fromkeys(terms))}
    base = base.select(id_col, "_n", "_avg", F.size("_tokens").alias("_len"), *[count_of("_tokens", t).alias(n) for t, n in names.items()], *[f"{n}d" for n in names.values()])
    score = F.lit(0.0)
    for t in terms:
        f, d = F.col(names[t]), F.col(f"{names[t]}d")
        idf = F.ln(1.0 + (F.col("_n") - d + 0.5) / (d + 0.5))
        score = score + idf * (f * (k1 + 1)) / (f + k1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return base.select(id_col, F.round(score, 6).alias("bm25"))


def _frequencies(query: str) -> list[Column]:
    """The number of rows, and of those that hold each term of the query."""
    held = [F.count(F.when(F.array_contains("_tokens", t), 1)).alias(f"_t{i}d") for i, t in enumerate(dict.fromkeys(tokens_of(query)))]
    return [F.greatest(F.count("*"), F.lit(1)).alias("_n"), *held]


def _mean_length(when: Column) -> Column:
    return F.greatest(F.coalesce(F.avg(F.when(when, F.size("_tokens"))), F.lit(1.0)), F.lit(1.0))


def bm25(corpus: DataFrame, docs: DataFrame, query: str, id_col: str, k1: float = K1) -> DataFrame:
    """(id, bm25) of `docs`; size and document frequencies are those of `corpus`, the average length that of `docs`.

    Repeated query terms count repeatedly; documents without any score 0 and stay.
    """
    whole, mean = corpus.agg(*_frequencies(query)), docs.agg(_mean_length(F.lit(True)).alias("_avg"))
    return _score(docs.select(id_col, "_tokens").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(mean)), query, id_col, k1)  # one row each


def hash_slot(term: Column) -> tuple[Column, Column]:
    """(dimension, sign) of a term, from its SHA-256."""
    digest = F.sha2(term, 256)
    number = lambda a, n: F.conv(F.substring(digest, a, n), 16, 10).cast("bigint")
    return (number(1, 8) % DIMENSIONS).cast("int"), F.when(number(9, 2) % 2 == 0, 1.0).otherwise(-1.0)


def query_vector(query: str) -> dict[int, float]:
    v: dict[int, float] = {}
    for t in tokens_of(query):
        d = hashlib.sha256(t.encode()).digest()
        at = int.from_bytes(d[:4], "big") % DIMENSIONS
        v[at] = v.get(at, 0.0) + (1.0 if d[4] % 2 == 0 else -1.0)
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {k: x / norm for k, x in v.items()}


def dense(docs: DataFrame, query: str, id_col: str) -> DataFrame:
    """(id, dense): cosine of signed feature hashes; documents without tokens score 0 and stay."""
    q = query_vector(query)
    at, sign = hash_slot(F.col("_term"))
    # The outer form keeps documents without tokens, as one cell that weighs nothing.
    cells = docs.select(id_col, F.explode_outer("_tokens").alias("_term")).groupBy(id_col, at.alias("_at")).agg(F.sum(F.when(F.col("_term").isNotNull(), sign).otherwise(0.0)).alias("_v"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in q.items() for x in kv]), F.col("_at")), F.lit(0.0)) if q else F.lit(0.0)
    score = F.sum(weight * F.col("_v")) / F.greatest(F.sqrt(F.sum(F.col("_v") * F.col("_v"))), F.lit(1e-300))
    return cells.groupBy(id_col).agg(F.round(F.coalesce(score, F.lit(0.0)), 6).alias("dense"))


def ranked(scores: DataFrame, score: str, id_col: str, limit: int) -> DataFrame:
    """The first `limit` rows with their rank: score descending, then id. The window runs over those rows only."""
    top = scores.orderBy(F.desc(score), id_col).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def rrf(rankings: list[DataFrame], id_col: str, k: int = RRF_K) -> DataFrame:
    """(id, fused): the sum of 1 / (k + rank) over rankings; a union and one aggregation instead of outer joins."""
    union = rankings[0].select(id_col, "rank")
    for r in rankings[1:]:
        union = union.union(r.select(id_col, "rank"))
    return union.groupBy(id_col).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("fused"))


def rerank_score(base: Column, title: Column | None, text: Column, query: str) -> Column:
    """Base plus 0.12 of the title's overlap, 0.05 of the body's and 0.03 if the phrase stands there."""
    q = sorted(set(tokens_of(query)))
    terms = F.array(*map(F.lit, q)) if q else F.array().cast("array<string>")
    share = lambda c: F.size(F.array_intersect(tokenize(c), terms)) / max(1, len(q))
    title = F.lit("") if title is None else title
    phrase = F.lower(F.concat_ws(" ", title, text)).contains(query.lower()).cast("double")
    return base + 0.12 * share(title) + 0.05 * share(text) + 0.03 * phrase


def knn_cosine(vectors: DataFrame, target: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(id, score): the k rows nearest to the one vector of `target` by cosine, exact."""
    one = target.select(F.col(vector).cast("array<double>").alias("_q")).limit(1)
    both = vectors.select(id_col, F.col(vector).cast("array<double>").alias("_v")).crossJoin(F.broadcast(one))  # one row
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    cosine = F.try_divide(dot(F.col("_v"), F.col("_q")), F.sqrt(dot(F.col("_v"), F.col("_v"))) * F.sqrt(dot(F.col("_q"), F.col("_q"))))
    return both.select(id_col, F.round(F.coalesce(cosine, F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def field_boost(df: DataFrame, query: str, id_col: str, fields: dict[str, float], k: int) -> DataFrame:
    """(id, score): the best field's boosted BM25 (k1 = 1.2), of documents that match at all."""
    scores = None
    for i, (field, boost) in enumerate(fields.items()):
        docs = with_tokens(df, field)
        s = bm25(docs, docs, query, id_col, k1=1.2).select(id_col, (F.col("bm25") * boost).alias(f"_f{i}"))
        scores = s if scores is None else scores.join(s, id_col)
    best = F.greatest(*[F.col(f"_f{i}") for i in range(len(fields))]) if len(fields) > 1 else F.col("_f0")
    return scores.select(id_col, F.round(best, 6).alias("score")).filter("score > 0").orderBy(F.desc("score"), id_col).limit(k)


def adapter_fusion(df: DataFrame, query: str, id_col: str, text: str, k: int) -> DataFrame:
    """(id, rank, score): both lists cut to k, fused and reranked, and not cut again: up to 2k rows."""
    docs = gate(with_tokens(df, text), query)
    lists = [ranked(bm25(docs, docs, query, id_col), "bm25", id_col, k), ranked(dense(docs, query, id_col), "dense", id_col, k)]
    hits = F.broadcast(rrf(lists, id_col)).join(df.select(id_col, F.col(text).alias("_text")), id_col)  # at most 2k rows
    scored = hits.select(id_col, F.round(rerank_score(F.col("fused"), None, F.col("_text"), query), 6).alias("score"))
    return ranked(scored, "score", id_col, 2 * k).select(id_col, "rank", "score")


def match_latest(df: DataFrame, query: str, fields: list[str], stamp: str, id_col: str, k: int) -> DataFrame:
    """Rows in which any query term stands in any of the fields, latest first: relevance does not rank them."""
    terms = F.array(*map(F.lit, sorted(set(tokens_of(query)))))
    hit = F.arrays_overlap(tokenize(F.concat_ws(" ", *fields)), terms)
    return df.filter(hit).orderBy(F.col(stamp).desc_nulls_last(), id_col).limit(k)


#: Platforms of discussion; every other is official.
PLATFORMS = ("bluesky", "mastodon", "youtube", "gdelt")


def coerce_hits(hits: DataFrame, regions: list[str], national: str = "AU") -> DataFrame:
    """Evidence of raw search hits: missing columns from the next best, values outside their lists to defaults.

    A region that is not listed is the national one, a date that is none is null, a platform that is not listed official.
    """
    has = {c.lower() for c in hits.columns}
    first = lambda *cs: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cs if c in has], F.lit(None))
    region, platform = first("city_context", "state"), first("platform")
    return hits.select(
        first("doc_id", "_id").alias("doc_id"), F.coalesce(first("title", "row_label"), F.lit("Untitled evidence")).alias("title"), F.coalesce(first("text"), F.lit("")).alias("text"),
        F.coalesce(first("source", "source_group"), F.lit("indexed-source")).alias("source"), F.when(region.isin(*regions), region).otherwise(national).alias("region"),
        F.try_to_date(F.substring(first("created_at", "period"), 1, 10), "yyyy-MM-dd").alias("period"), F.coalesce(first("topic", "row_label"), F.lit("housing")).alias("topic"),
        F.when(platform.isin(*PLATFORMS), platform).otherwise("official").alias("platform"),
    )
