"""Registered retrieval queries with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumlens.operators import inverted, nearest, retrieval
from forumlens.operators.inverted import Question
from forumlens.plans.registry import query
from forumlens.session import fresh_dir, table

QUERY = "the mit license of thing"

_TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query(
    "corpus_df",
    f"""SELECT lang, term, count(*) AS df FROM (SELECT DISTINCT lang, doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL""",
)
def corpus_df(spark, sf):
    return retrieval.corpus_df(table(spark, sf, "documents"), "lang", "text")


def base_sql(where: str = "lang = 'en'", asked: str = QUERY, wide: int = 40, cut: int = 20) -> str:
    need = ", ".join(f"'{t}'" for t in retrieval.important_terms(asked))
    terms = ", ".join(f"'{t}'" for t in retrieval.tokens_of(asked))
    return rf"""WITH c AS (SELECT *, {_TOKENS.format('text')} AS t FROM documents),
d AS (SELECT * FROM c WHERE {where} AND list_has_any(t, [{need}])),
q AS (SELECT unnest([{terms}]) AS term, unnest(range({len(retrieval.tokens_of(asked))})) AS i),
n AS (SELECT greatest(count(*), 1) AS n FROM c), a AS (SELECT greatest(coalesce(avg(len(t)), 1), 1) AS a FROM d),
f AS (SELECT term, i, (SELECT count(*) FROM c WHERE list_contains(t, term)) AS df FROM q),
bm AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len(t) / a))), 6) AS bm25
       FROM (SELECT doc_id, t, df, len(list_filter(t, lambda x: x = term)) AS tf FROM d, f), n, a GROUP BY doc_id),
cells AS (SELECT doc_id, ('0x' || sha256(term)[1:8])::BIGINT % 128 AS slot, sum(CASE WHEN ('0x' || sha256(term)[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v
          FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
qc AS (SELECT ('0x' || sha256(term)[1:8])::BIGINT % 128 AS slot, sum(CASE WHEN ('0x' || sha256(term)[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM q GROUP BY 1),
qn AS (SELECT slot, v / (SELECT sqrt(sum(v * v)) FROM qc) AS v FROM qc),
de AS (SELECT doc_id, round(sum(coalesce(qn.v, 0) * cells.v) / sqrt(sum(cells.v * cells.v)), 6) AS dense FROM cells LEFT JOIN qn USING (slot) GROUP BY 1),
rb AS (SELECT doc_id, bm25, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM bm ORDER BY 3 LIMIT {wide}),
rd AS (SELECT doc_id, dense, row_number() OVER (ORDER BY dense DESC, doc_id) AS rank FROM de ORDER BY 3 LIMIT {wide}),
fu AS (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused FROM (SELECT doc_id, rank FROM rb UNION ALL SELECT doc_id, rank FROM rd) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {cut}),
re AS (SELECT doc_id, text, round(fused + 0.05 * (len(list_intersect(list_distinct(t), [{', '.join(f"'{x}'" for x in sorted(set(retrieval.tokens_of(asked))))}])) / {len(set(retrieval.tokens_of(asked)))})
       + 0.03 * contains(lower(text), '{asked}')::INT, 6) AS score FROM fu JOIN c USING (doc_id)),
"""


_SQUEEZED = r"trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def gated(spark, sf):
    corpus = retrieval.with_tokens(table(spark, sf, "documents"), "text")
    return corpus, retrieval.gate(corpus.filter("lang = 'en'"), QUERY)


@query("gate_overlap", base_sql() + "z AS (SELECT 1) SELECT doc_id FROM d")
def gate_overlap(spark, sf):
    return gated(spark, sf)[1].select("doc_id")


@query("bm25_topk", base_sql() + "z AS (SELECT 1) SELECT doc_id, bm25, rank::INT AS rank FROM rb")
def bm25_topk(spark, sf):
    return retrieval.ranked(retrieval.bm25(*gated(spark, sf), QUERY, "doc_id"), "bm25", "doc_id", 40)


@query("hashed_dense_topk", base_sql() + "z AS (SELECT 1) SELECT doc_id, dense, rank::INT AS rank FROM rd")
def hashed_dense_topk(spark, sf):
    return retrieval.ranked(retrieval.dense(gated(spark, sf)[1], QUERY, "doc_id"), "dense", "doc_id", 40)


@query("rrf_fusion", base_sql() + "z AS (SELECT 1) SELECT doc_id, fused FROM fu")
def rrf_fusion(spark, sf):
    corpus, docs = gated(spark, sf)
    lists = [retrieval.ranked(retrieval.bm25(corpus, docs, QUERY, "doc_id"), "bm25", "doc_id", 40), retrieval.ranked(retrieval.dense(docs, QUERY, "doc_id"), "dense", "doc_id", 40)]
    return retrieval.rrf(lists, "doc_id").orderBy(F.desc("fused"), "doc_id").limit(20)


@query(
    "hybrid_search",
    base_sql()
    + rf"""z AS (SELECT doc_id, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank, score, {_SQUEEZED} AS s FROM re)
SELECT doc_id, rank, score, CASE WHEN length(s) <= 240 THEN s ELSE rtrim(s[1:239]) || '…' END AS snippet FROM z WHERE rank <= 10""",
)
def hybrid_search(spark, sf):
    return inverted.search(table(spark, sf, "documents"), QUERY, "doc_id", "text", where=F.col("lang") == "en", k=10)


@query(
    "lexical_rerank",
    rf"""SELECT item_id, round(0.05 * (len(list_intersect(list_distinct({_TOKENS.format('text')}), ['of', 'the'])) / 2) + 0.03 * contains(lower(text), 'of the')::INT, 6) AS score FROM benchmark""",
)
def lexical_rerank(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.round(retrieval.rerank_score(F.lit(0.0), None, F.col("text"), "of the"), 6).alias("score"))


@query(
    "knn_cosine",
    """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS score
FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 20""",
)
def knn_cosine(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return retrieval.knn_cosine(vectors, vectors.filter("vec_id = 3"), "vec_id", "embedding", 20)


def _field_sql(field: str, boost: float, i: int) -> str:
    return rf"""c{i} AS (SELECT page_id, {_TOKENS.format(field)} AS t FROM pages), n{i} AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS a FROM c{i}),
f{i} AS (SELECT term, (SELECT count(*) FROM c{i} WHERE list_contains(t, term)) AS df FROM q),
s{i} AS (SELECT page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len(t) / a))), 6) * {boost}::DOUBLE AS s
  FROM (SELECT page_id, t, df, len(list_filter(t, lambda x: x = term)) AS tf FROM c{i}, f{i}), n{i} GROUP BY 1)"""


@query(
    "field_boost_match",
    f"""WITH q AS (SELECT unnest(['about', 'the', 'news']) AS term), {_field_sql('url', 2.0, 0)}, {_field_sql('html', 1.0, 1)}
SELECT page_id, round(greatest(s0.s, s1.s), 6) AS score FROM s0 JOIN s1 USING (page_id) WHERE greatest(s0.s, s1.s) > 0 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def field_boost_match(spark, sf):
    return retrieval.field_boost(table(spark, sf, "pages"), "about the news", "page_id", {"url": 2.0, "html": 1.0}, 20)


@query(
    "adapter_fusion",
    base_sql("true").replace("LIMIT 40", "LIMIT 10").replace("n AS (SELECT greatest(count(*), 1) AS n FROM c)", "n AS (SELECT greatest(count(*), 1) AS n FROM d)").replace("(SELECT count(*) FROM c WHERE", "(SELECT count(*) FROM d WHERE")
    + "z AS (SELECT 1) SELECT doc_id, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank, score FROM re",
)
def adapter_fusion(spark, sf):
    return retrieval.adapter_fusion(table(spark, sf, "documents"), QUERY, "doc_id", "text", 10)


@query(
    "match_latest",
    rf"SELECT doc_id, n_chars FROM documents WHERE list_has_any({_TOKENS.format("source || ' ' || text")}, ['apache', 'mit']) ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 25",
)
def match_latest(spark, sf):
    return retrieval.match_latest(table(spark, sf, "documents"), "MIT Apache", ["source", "text"], "n_chars", "doc_id", 25).select("doc_id", "n_chars")


FACETS = {"corpus": "lang", "region": "source"}


def indexed(spark, sf):
    """An inverted index of `documents`, below the shared folder."""
    return inverted.InvertedIndex.build(table(spark, sf, "documents"), "doc_id", F.col("text"), fresh_dir(spark, "index"), FACETS)


@query("index_bm25_topk", base_sql() + "z AS (SELECT 1) SELECT doc_id, bm25, rank::INT AS rank FROM rb")
def index_bm25_topk(spark, sf):
    """bm25_topk from the index alone."""
    index = indexed(spark, sf)
    asked = inverted.Asked(spark, [Question(QUERY, {"corpus": ("en",)})], index.kinds)
    return index.top_bm25(asked, 40)[1].select(F.col("id").alias("doc_id"), "bm25", "rank")


#: Fifty questions: five texts about twenty regions, of which some are of one corpus. Each has two important terms or more, so
#: that no gate stands open.
ASKED = [
    Question(text, {"region": (f"src{n}", "src0")} | ({"corpus": ("en", "fr")} if n % 3 else {}))
    for text in ("mit license", "the apache license version", "general public license of the", "password secret token", "this worthless document") for n in range(1, 11)
]


def many_sql(questions: list[Question], k: int) -> str:
    """The answers to questions whose gates are shut, by one statement over tables of questions and of their terms."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]" if xs else "NULL"
    rows = ", ".join(f"({n}, {quoted(q.only.get('corpus'))}, {quoted(q.only.get('region'))}, '{q.text}', {quoted(sorted(set(retrieval.tokens_of(q.text))))})" for n, q in enumerate(questions))
    terms = ", ".join(f"({n}, '{t}', {t in retrieval.important_terms(q.text)})" for n, q in enumerate(questions) for t in retrieval.tokens_of(q.text))
    wide, cut = max(4 * k, 20), max(2 * k, 10)
    slot = "('0x' || sha256(term)[1:8])::BIGINT % 128 AS slot, sum(CASE WHEN ('0x' || sha256(term)[9:10])::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v"
    return rf"""WITH qs(question, corpora, regions, phrase, words) AS (VALUES {rows}), qt(question, term, important) AS (VALUES {terms}),
c AS (SELECT *, {_TOKENS.format('text')} AS t FROM documents), n AS (SELECT greatest(count(*), 1) AS n FROM c),
p AS (SELECT doc_id, lang, source, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS tf FROM c, (SELECT DISTINCT term FROM qt) WHERE list_contains(t, term)),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
d AS (SELECT DISTINCT question, doc_id, len FROM p JOIN qt USING (term) JOIN qs USING (question) WHERE important AND coalesce(list_contains(corpora, lang), corpora IS NULL) AND coalesce(list_contains(regions, source), regions IS NULL)),
a AS (SELECT question, greatest(avg(len), 1) AS a FROM d GROUP BY 1),
bm AS (SELECT question, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * d.len / a))), 6) AS bm25
       FROM d JOIN qt USING (question) JOIN p USING (doc_id, term) JOIN f USING (term) JOIN a USING (question), n GROUP BY ALL),
cells AS (SELECT doc_id, {slot} FROM (SELECT doc_id, unnest(t) AS term FROM c WHERE doc_id IN (SELECT doc_id FROM d)) GROUP BY ALL),
norms AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY 1),
qc AS (SELECT question, {slot} FROM qt GROUP BY ALL), qn AS (SELECT question, slot, v / sqrt(sum(v * v) OVER (PARTITION BY question)) AS v FROM qc),
dots AS (SELECT question, doc_id, sum(qn.v * cells.v) AS dot FROM d JOIN cells USING (doc_id) JOIN qn USING (question, slot) GROUP BY ALL),
de AS (SELECT question, doc_id, round(coalesce(dot, 0) / norm, 6) AS dense FROM d JOIN norms USING (doc_id) LEFT JOIN dots USING (question, doc_id)),
rb AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY bm25 DESC, doc_id) AS rank FROM bm QUALIFY rank <= {wide}),
rd AS (SELECT question, doc_id, row_number() OVER (PARTITION BY question ORDER BY dense DESC, doc_id) AS rank FROM de QUALIFY rank <= {wide}),
fu AS (SELECT question, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS fused FROM (SELECT * FROM rb UNION ALL SELECT * FROM rd) GROUP BY question, doc_id),
fc AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY question ORDER BY fused DESC, doc_id) <= {cut}),
re AS (SELECT question, doc_id, round(fused + 0.05 * (len(list_intersect(list_distinct(t), words)) / len(words)) + 0.03 * contains(lower(text), phrase)::INT, 6) AS score FROM fc JOIN c USING (doc_id) JOIN qs USING (question))
SELECT question, doc_id, (row_number() OVER (PARTITION BY question ORDER BY score DESC, doc_id))::INT AS rank, score FROM re QUALIFY rank <= {k}"""


def _asked(source, spark, sf, k):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return inverted.ask(source, texts, ASKED, k).select("question", F.col("id").alias("doc_id"), "rank", "score")


@query("many_questions", many_sql(ASKED, 5))
def many_questions(spark, sf):
    """Fifty questions in one plan, whose tokens are cut once."""
    return _asked(inverted.Corpus(table(spark, sf, "documents"), "doc_id", F.col("text"), FACETS), spark, sf, 5)


@query("index_many_questions", many_sql(ASKED, 3))
def index_many_questions(spark, sf):
    """Fifty questions to the index."""
    return _asked(indexed(spark, sf), spark, sf, 3)


_COSINE = "round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))), 6)"


def vector_index(spark, sf):
    return nearest.VectorIndex.build(table(spark, sf, "embeddings"), "vec_id", "embedding", fresh_dir(spark, "vectors"), {"label": "label"})


def asked_vectors(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query(
    "knn_filtered",
    f"""SELECT q.vec_id AS query, v.vec_id AS id, (row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE} DESC, v.vec_id))::INT AS rank, {_COSINE} AS score
FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.label IN (1, 2) QUALIFY rank <= 10""",
)
def knn_filtered(spark, sf):
    """The nearest rows of two labels, with all cells looked into, so that the answer is exact."""
    index = vector_index(spark, sf)
    return index.nearest(asked_vectors(spark, sf), 10, where=F.col("about.label").isin(1, 2), probes=len(index.centres))


@query("knn_cells_recall", "SELECT count(*) FILTER (vec_id % 50 = 0) AS queries, count(*) AS rows, true AS recalled FROM embeddings")
def knn_cells_recall(spark, sf):
    """Whether the cells that the index has measured to be enough find nine in ten of the ten nearest rows of every query."""
    index, asked = vector_index(spark, sf), asked_vectors(spark, sf)
    found = [index.nearest(asked, 10, probes=n).select("query", "id") for n in (None, len(index.centres))]
    both = found[0].join(found[1], ["query", "id"]).agg(F.count("*").alias("both"))
    counts = index.rows().agg(F.count(F.when(F.col("id") % 50 == 0, 1)).alias("queries"), F.count("*").alias("rows"))
    return counts.crossJoin(both).crossJoin(found[1].agg(F.count("*").alias("all"))).select("queries", "rows", (F.col("both") >= 0.9 * F.col("all")).alias("recalled"))  # one row each
