"""The registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from forumlens.llm import divergence, exact_dedup, language, licenses, mixing, packing, quality, secrets, sharding, simhash, spelling, token_counts, topk
from forumlens.session import table

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


N_SHARDS = 40

#: Jump hash as a list reduction over (key halves as one UHUGEINT, bucket, shard, grown shard); CRC-32 byte by byte.
_OP1 = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n) AS c
    FROM range(0, 256) r(n))
), sized AS (
  SELECT doc_id, row_number() OVER () AS rid, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
         list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT) AS c,
         md5(coalesce(doc_id::VARCHAR, chr(0) || 'null')) AS m
  FROM documents, crc_table
), jump AS (
  SELECT rid, 0 AS step, ('0x' || m[1:16])::UBIGINT::UHUGEINT AS k,
         0::BIGINT AS j, 0::BIGINT AS shard, 0::BIGINT AS grown FROM sized
  UNION ALL
  SELECT rid, step + 1, k, j, CASE WHEN j < 40 THEN j ELSE shard END, CASE WHEN j < 41 THEN j ELSE grown END FROM (
    SELECT rid, step, (k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT AS k, shard, grown,
           floor((j + 1) * (2147483648.0::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616::UHUGEINT // 8589934592::UHUGEINT) + 1)::DOUBLE))::BIGINT AS j
    FROM jump WHERE j <= 40)
), last AS (SELECT rid, arg_max(shard, step) AS shard, arg_max(grown, step) AS grown FROM jump GROUP BY rid)
SELECT doc_id, size, xor(c, 4294967295::BIGINT)::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || m[17:24])::BIGINT % 64, doc_id, xor(c, 4294967295::BIGINT), size) - 1 AS slot, grown::INT AS grown_shard
FROM sized JOIN last USING (rid)
"""


@query("op1_sharding", _OP1)
def op1_sharding(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = sharding.shard_documents(docs, N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, (count(*) OVER (PARTITION BY t))::BIGINT AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""


@query("op7_exact_dedup", _OP7)
def op7_exact_dedup(spark, sf_dir):
    marked = exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id", F.col("dedup_keep_id").alias("keep_id"), F.col("dedup_group_size").alias("group_size"),
        F.col("dedup_kept").alias("kept"), F.col("dedup_digest").alias("text_sha256"),
    )


@query("op4_simhash_near_dedup")
def op4_simhash_near_dedup(spark, sf_dir):
    out = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"), width=3, budget=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_token_counts")
def op2_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query("op6_secret_scan")
def op6_secret_scan(spark, sf_dir):
    out = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.sha2(joined("secrets.base"), 256).alias("base_sha256")
    return out.select("doc_id", *map(count, secrets.KINDS), base, joined("secrets.every").alias("spans"))


def _license_oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(
        f"({t}, {quoted(label)}, {str(whole).lower()}, {k}, {size}, {q}, [{', '.join(map(quoted, run))}])"
        for t, label, whole, k, size, q, run in licenses.template_rows(licenses.PHRASES, licenses.TEXTS)
    )
    return rf"""
WITH runs(template, label, whole, k, size, q, run) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT r, k, p, w[p + 1:p + k] AS run FROM (SELECT r, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (VALUES ({licenses.SHORT}), ({licenses.LONG})) ks(k))),
hits AS (SELECT r, template, label, whole, g.k, size, q, p, p - q AS d FROM grams g JOIN runs USING (k, run)),
marked AS (SELECT *, coalesce(d - lag(d) OVER (PARTITION BY r, template ORDER BY d) > CASE WHEN whole THEN 0 ELSE {licenses.APART} END, true)::INT AS new FROM hits),
spans AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY d ROWS UNBOUNDED PRECEDING) AS span FROM marked),
merged AS (SELECT r, label, whole, min(p) AS s, list(DISTINCT q) AS qs, k, size FROM spans GROUP BY r, template, label, whole, k, size, span),
good AS (SELECT * FROM (SELECT r, label, whole, s, len(list_distinct(flatten(list_transform(qs, lambda q: range(q, q + k))))) / size AS cover FROM merged)
         WHERE CASE WHEN whole THEN cover = 1 ELSE cover >= {licenses.SHARE} END),
found AS (SELECT r, count(*) FILTER (whole) AS n_base, min(s) FILTER (whole) AS first_word, max(s) FILTER (whole) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score
          FROM good GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r)
"""


@query("op3_license_scan", _license_oracle())
def op3_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query("op10_quality_classifier")
def op10_quality_classifier(spark, sf_dir):
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    kept = F.col("quality_kept").alias("kept")
    return out.select("doc_id", F.col("quality_votes").alias("votes"), F.round("junk_score", 6).alias("junk_score"), F.round("toxic_score", 6).alias("toxic_score"), kept)


_OP5 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.rid <> q.rid)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


@query("op5_exact_top_k", _OP5)
def op5_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


#: Poisson steps of each source as a list, of which a document's uniform number passes as many as it gets copies.
_OP9 = """
WITH sizes AS (SELECT coalesce(source, chr(0) || 'null') AS k, sum(octet_length(encode(coalesce(text, ''))) + 1) AS size FROM documents GROUP BY 1),
rates AS (SELECT k, pow(size, 0.7) / sum(pow(size, 0.7)) OVER () * sum(size) OVER () / size AS rate FROM sizes),
steps AS (SELECT k, rate, list(p ORDER BY i) AS steps FROM (
  SELECT k, rate, i, sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (PARTITION BY k ORDER BY i) AS p
  FROM rates, range(0, 200) r(i)) GROUP BY k, rate),
drawn AS (SELECT doc_id, source, rate, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS ident,
                 len(list_filter(steps, lambda p: p <= ('0x' || md5('mix' || chr(31) || coalesce(doc_id::VARCHAR, chr(0) || 'null'))[1:13])::BIGINT / 4503599627370496.0::DOUBLE)) AS copies
          FROM documents JOIN steps ON k = coalesce(source, chr(0) || 'null'))
SELECT doc_id, source, round(rate, 6) AS rate, copies::BIGINT AS copies, copy, ('0x' || md5('mix order' || chr(31) || ident || chr(31) || copy::VARCHAR)[1:15])::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(copies)) AS copy FROM drawn)
"""


@query("op9_mixing", _OP9)
def op9_mixing(spark, sf_dir):
    out = mixing.mix(table(spark, sf_dir, "documents"), alpha=0.7, epochs=1.0, seed="mix")
    return out.select("doc_id", "source", F.round("mix_rate", 6).alias("rate"), F.col("mix_copies").alias("copies"), F.col("mix_copy").alias("copy"), F.col("mix_order").alias("shuffle_key"))


#: CRC-32 of the expression in braces byte by byte, with the table `crc_table` of _CRC_TABLE.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n) AS c
    FROM range(0, 256) r(n))
)"""
_CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"""

_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{licenses.UPPER}', '{licenses.LOWER}') AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC.format("id || ':' || run")} AS h FROM counted, crc_table),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near FROM less a JOIN less b USING (i, d) WHERE a.word <> b.word
         UNION SELECT less.word, d FROM less JOIN words w ON w.word = d
         UNION SELECT d, less.word FROM less JOIN words w ON w.word = d),
best AS (SELECT near.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS top, max(w.n) AS top_n FROM near JOIN words w ON w.word = near GROUP BY near.word),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top END AS form, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n FROM words LEFT JOIN best USING (word)),
up AS (SELECT word, form AS root FROM named WHERE form IS NOT NULL UNION ALL SELECT up.word, named.form FROM up JOIN named ON named.word = up.root WHERE named.form IS NOT NULL),
ends AS (SELECT up.word, root FROM up JOIN named ON named.word = up.root WHERE named.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM named LEFT JOIN ends USING (word)
"""


@query("op11_spelling_variants", _OP11)
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_OP12 = rf"""
WITH {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_CRC.format("coalesce(doc_id::VARCHAR, '')")} % 3 = 1 AS held_out,
             CASE WHEN regexp_matches(text, '\pL') THEN ' ' || trim(regexp_replace(lower(text), '[^\pL]+', ' ', 'g')) || ' ' END AS t FROM documents, crc_table),
letters AS (SELECT r, lang, held_out, unnest(string_split(t, '')) AS c, unnest(range(1, length(t) + 1)) AS i FROM d WHERE t IS NOT NULL),
runs AS (SELECT r, lang, held_out, c, lead(c, 1) OVER w AS c2, lead(c, 2) OVER w AS c3 FROM letters WINDOW w AS (PARTITION BY r ORDER BY i)),
grams AS (SELECT r, any_value(lang) AS lang, any_value(held_out) AS held_out, g, count(*) AS n
          FROM (SELECT r, lang, held_out, unnest([c, c || c2, c || c2 || c3]) AS g FROM runs) WHERE g <> ' ' GROUP BY r, g),
own AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, length(g), g) - 1 AS place FROM grams QUALIFY place < {language.RANKS}),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS place FROM grams
            WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY place < {language.RANKS}),
met AS (SELECT r, p.lang, count(*) AS n, sum(abs(own.place - p.place)) AS off FROM own JOIN profile p USING (g) GROUP BY ALL),
sizes AS (SELECT r, count(*) AS m FROM own GROUP BY r),
far AS (SELECT r, l.lang, m, coalesce(off, 0) + (m - coalesce(n, 0)) * {language.RANKS} AS off FROM sizes CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN met USING (r, lang)),
best AS (SELECT r, first(lang ORDER BY off, lang) AS lang, min(off) AS off, any_value(m) AS m FROM far GROUP BY r)
SELECT doc_id, held_out, coalesce(best.lang, '{language.UNDETERMINED}') AS lang_pred, coalesce(1.0::DOUBLE - off::DOUBLE / (m * {language.RANKS})::DOUBLE, 0) AS score FROM d LEFT JOIN best USING (r)
"""


@query("op12_language_id", _OP12)
def op12_language_id(spark, sf_dir):
    out = language.identify_held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
sizes AS (SELECT lang, count(kept.term) AS v, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL),
dense AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS own
          FROM groups g JOIN kept USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
cells AS (SELECT lang, source, term, n, (1 + ({divergence.WHOLE}::HUGEINT * (n + {divergence.SMOOTHING})) // (own + {divergence.SMOOTHING} * v))::BIGINT AS p,
                 (1 + ({divergence.WHOLE}::HUGEINT * (lang_n + {divergence.SMOOTHING})) // (total + {divergence.SMOOTHING} * v))::BIGINT AS q FROM dense JOIN sizes USING (lang)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM cells a JOIN cells b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM groups a JOIN groups b USING (lang) LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source WHERE a.source <> b.source
          UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM parts QUALIFY part = 'pair' OR rank <= {divergence.TOP}
"""


@query("op13_source_divergence", _OP13)
def op13_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))
