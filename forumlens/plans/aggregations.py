"""Registered aggregation, filter, set and deduplication queries with their DuckDB equivalents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from forumlens.functions import dates
from forumlens.functions.rules import first_match
from forumlens.functions.text import cloud_words, tokenize
from forumlens.operators import aggs, dedup, filters
from forumlens.plans.registry import query
from forumlens.session import table

STOPWORDS = ["the", "and", "that", "was", "for", "with", "this", "are", "from"]


@query("terms_top_priority", "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def terms_top_priority(spark, sf):
    return aggs.terms(table(spark, sf, "orders"), "o_orderpriority", 3)


@query("terms_key_order", "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 4")
def terms_key_order(spark, sf):
    return aggs.terms(table(spark, sf, "events"), "event_type", 4, by_key=True)


@query("terms_missing_bucket", "SELECT coalesce(quality::VARCHAR, 'unknown') AS quality, count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def terms_missing_bucket(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return aggs.terms(both, F.col("quality").cast("string"), 10, name="quality", missing="unknown")


@query(
    "nested_terms_brand_type",
    """WITH p AS (SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY ALL),
o AS (SELECT p_brand, sum(count)::BIGINT AS outer_count FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT p_brand, outer_count, p_type, count FROM p JOIN o USING (p_brand)
QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count DESC, p_type) <= 3""",
)
def nested_terms_brand_type(spark, sf):
    return aggs.nested_terms(table(spark, sf, "part"), "p_brand", "p_type", 5, 3)


@query(
    "nested_terms_group_period",
    """WITH p AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS period, count(*) AS count FROM orders GROUP BY ALL),
o AS (SELECT o_orderpriority, sum(count)::BIGINT AS outer_count FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT o_orderpriority, outer_count, period, count FROM p JOIN o USING (o_orderpriority)
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY period) <= 12""",
)
def nested_terms_group_period(spark, sf):
    df = table(spark, sf, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    return aggs.nested_terms(df, "o_orderpriority", "period", 3, 12, inner_by_key=True)


for _i in ("day", "week", "month", "quarter", "year"):

    @query(f"hist_calendar_{_i}", f"SELECT date_trunc('{_i}', o_orderdate)::DATE AS date, count(*) AS count FROM orders GROUP BY 1")
    def hist_calendar(spark, sf, interval=_i):
        return aggs.date_histogram(table(spark, sf, "orders"), "o_orderdate", interval)


@query("hist_by_type_flat", "SELECT date_trunc('day', ts)::DATE AS date, event_type, count(*) AS count FROM events GROUP BY ALL")
def hist_by_type_flat(spark, sf):
    return aggs.date_histogram(table(spark, sf, "events"), "ts", "day", ["event_type"])


@query(
    "hist_daily_gap_filled",
    """WITH c AS (SELECT user_id, ts::DATE AS date, count(*) AS count FROM events GROUP BY ALL),
d AS (SELECT user_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM c GROUP BY 1)
SELECT user_id, date, coalesce(count, 0)::BIGINT AS count FROM d LEFT JOIN c USING (user_id, date)""",
)
def hist_daily_gap_filled(spark, sf):
    return aggs.date_histogram(table(spark, sf, "events"), "ts", "day", ["user_id"], densify=True)


_STATS = "count({0}) AS count, round(min({0}), 6) AS min, round(max({0}), 6) AS max, round(avg({0}), 6) AS avg, round(sum({0}), 6) AS sum"


@query("stats_value", f"SELECT event_type, {_STATS.format('value')} FROM events GROUP BY 1")
def stats_value(spark, sf):
    return aggs.stats(table(spark, sf, "events"), "value", ["event_type"], 6)


@query("stats_lineitem", f"SELECT l_returnflag, l_linestatus, {_STATS.format('l_quantity')} FROM lineitem GROUP BY ALL")
def stats_lineitem(spark, sf):
    return aggs.stats(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"], 6)


@query("cardinality_exact", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS \"distinct\" FROM orders GROUP BY 1")
def cardinality_exact(spark, sf):
    return aggs.cardinality(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority"])


@query("cardinality_approx", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS exact, true AS close FROM orders GROUP BY 1")
def cardinality_approx(spark, sf):
    """The estimate is within a tenth of the exact count: twice its standard error."""
    orders = table(spark, sf, "orders")
    near = aggs.cardinality(orders, "o_custkey", ["o_orderpriority"], exact=False).withColumnRenamed("distinct", "near")
    both = aggs.cardinality(orders, "o_custkey", ["o_orderpriority"]).withColumnRenamed("distinct", "exact").join(near, "o_orderpriority")
    return both.select("o_orderpriority", "exact", (F.abs(F.col("near") - F.col("exact")) <= 0.1 * F.col("exact")).alias("close"))


@query(
    "sub_aggs_label_pivot",
    """SELECT user_id, count(*) AS count, round(avg(value), 6) AS avg, count(*) FILTER (event_type = 'click') AS click,
count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""",
)
def sub_aggs_label_pivot(spark, sf):
    return aggs.label_pivot(table(spark, sf, "events"), "user_id", "event_type", ["click", "view", "purchase"], "value")


_RATIOS = """count(*) AS count, count(*) FILTER ({0} = '{1}') AS neg, count(*) FILTER ({0} = '{2}') AS pos,
round(count(*) FILTER ({0} = '{1}') / greatest(1, count(*)), 4) AS neg_ratio, round(count(*) FILTER ({0} = '{2}') / greatest(1, count(*)), 4) AS pos_ratio"""


@query("label_ratios_by_group", f"SELECT source, {_RATIOS.format('quality', 0, 1)} FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_ratios_by_group(spark, sf):
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return aggs.label_ratios(both.withColumn("quality", F.col("quality").cast("string")), "source", "quality", "0", "1")


@query("label_ratios_over_time", f"SELECT date_trunc('week', ts)::DATE AS date, {_RATIOS.format('event_type', 'error', 'purchase')} FROM events GROUP BY 1")
def label_ratios_over_time(spark, sf):
    return aggs.label_ratios(table(spark, sf, "events"), aggs.bucket("ts", "week"), "event_type", "error", "purchase", name="date")


@query("volume_with_metric_added", "SELECT role, (count(*) + CASE WHEN role = 'user' THEN sum(turn) ELSE 0 END)::BIGINT AS volume FROM conversations GROUP BY 1")
def volume_with_metric_added(spark, sf):
    return aggs.volume_with_metric(table(spark, sf, "conversations"), "role", "user", "turn")


@query(
    "word_count_recent_topk",
    rf"""WITH d AS (SELECT doc_id, text FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 300),
w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z''\-]{{2,}}')) AS w FROM d),
s AS (SELECT regexp_replace(regexp_replace(lower(w), '^[''\-]+|[''\-]+$', '', 'g'), '''s$', '') AS w FROM w),
f AS (SELECT CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END AS word FROM s)
SELECT word, count(*) AS count FROM f WHERE length(word) >= 3 AND word NOT IN ({', '.join(f"'{x}'" for x in STOPWORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""",
)
def word_count_recent_topk(spark, sf):
    return aggs.word_counts(table(spark, sf, "documents"), cloud_words("text", STOPWORDS), "n_chars", "doc_id", 300, 50)


_ROLLUP = [("ones", "(^|_)src1"), ("low", "src[2-4]"), ("high", "src[5-9]")]


@query(
    "region_rollup_two_stage",
    """WITH t AS (SELECT source, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 500),
l AS (SELECT *, CASE WHEN regexp_matches(source, '(^|_)src1') THEN 'ones' WHEN regexp_matches(source, 'src[2-4]') THEN 'low' WHEN regexp_matches(source, 'src[5-9]') THEN 'high' ELSE 'Other' END AS label FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC, source) AS r FROM l)
SELECT label, sum(count)::BIGINT AS count, string_agg(source, '; ' ORDER BY r) FILTER (r <= 5) AS examples FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""",
)
def region_rollup_two_stage(spark, sf):
    return aggs.rollup_labels(table(spark, sf, "documents"), "source", first_match("source", _ROLLUP, "Other"))


@query("eval_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def eval_percentiles(spark, sf):
    return aggs.percentiles(table(spark, sf, "events"), "value", "event_type")


@query(
    "gauge_quantiles",
    """SELECT event_type, round(value, 6) AS quantile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r,
count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = floor(0.95 * (n - 1))""",
)
def gauge_quantiles(spark, sf):
    return aggs.floor_quantile(table(spark, sf, "events"), "value", "event_type", 0.95)


@query(
    "eval_ratios",
    """SELECT event_type, count(*) AS count, round(avg((value > 50)::INT), 6) AS success, round(sum((value > 90)::INT) / nullif(sum((value > 50)::INT), 0), 6) AS recovered
FROM events GROUP BY 1""",
)
def eval_ratios(spark, sf):
    ok, best = (F.col("value") > 50).cast("int"), (F.col("value") > 90).cast("int")
    out = table(spark, sf, "events").groupBy("event_type")
    return out.agg(F.count("*").alias("count"), F.round(F.avg(ok), 6).alias("success"), F.round(F.try_divide(F.sum(best), F.sum(ok)), 6).alias("recovered"))


@query(
    "coverage_report",
    "SELECT lang, count(*) AS count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(n_chars) AS first, max(n_chars) AS last FROM documents GROUP BY 1",
)
def coverage_report(spark, sf):
    return aggs.coverage(table(spark, sf, "documents"), "lang", "source", "n_chars")


@query(
    "topic_counts",
    """SELECT 'total' AS panel, NULL::VARCHAR AS key, count(*) AS count FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(thing|ion)([^a-z0-9]|$)')
UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(thing|ion)([^a-z0-9]|$)') GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])(thing|ion)([^a-z0-9]|$)') GROUP BY 2""",
)
def topic_counts(spark, sf):
    hit = F.arrays_overlap(tokenize("text"), F.array(F.lit("thing"), F.lit("ion")))
    return aggs.multi_terms(table(spark, sf, "documents").filter(hit), ["lang", "source"])


@query(
    "grouping_sets_panel",
    """SELECT 'total' AS panel, NULL::VARCHAR AS key, count(*) AS count FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2""",
)
def grouping_sets_panel(spark, sf):
    return aggs.multi_terms(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("filter_exact_terms", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_exact_terms(spark, sf):
    return table(spark, sf, "orders").filter(filters.exact(o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None)).select("o_orderkey")


@query("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-04-01'")
def filter_date_range(spark, sf):
    return table(spark, sf, "orders").filter(filters.date_range("o_orderdate", date(1996, 1, 1), date(1996, 3, 31))).select("o_orderkey")


@query("filter_null_tolerant_range", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def filter_null_tolerant_range(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return both.filter(filters.null_tolerant_range("quality", F.lit(1))).select("doc_id", "quality")


@query("filter_region_or_national", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'en')")
def filter_region_or_national(spark, sf):
    return table(spark, sf, "documents").filter(filters.region_or_national("lang", "de", "en")).select("doc_id", "lang")


@query("filter_contains_ci", "SELECT doc_id FROM documents WHERE contains(lower(source), 'src1')")
def filter_contains_ci(spark, sf):
    return table(spark, sf, "documents").filter(filters.contains_ci("source", "SRC1")).select("doc_id")


@query("having_min_doc_count", "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 HAVING count(*) >= 80 ORDER BY 2 DESC, 1 LIMIT 10")
def having_min_doc_count(spark, sf):
    return aggs.terms(table(spark, sf, "part"), "p_brand", 10, min_count=80)


@query("exclude_regex", "SELECT source, count(*) AS count FROM documents WHERE NOT regexp_full_match(source, '[sS]rc1.*') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def exclude_regex(spark, sf):
    return aggs.terms(table(spark, sf, "documents"), "source", 8, exclude="[sS]rc1.*")


@query("relative_range_days", "SELECT event_type, count(*) AS count FROM events WHERE ts >= date_trunc('day', (SELECT max(ts) FROM events)) - INTERVAL 7 DAY GROUP BY 1")
def relative_range_days(spark, sf):
    events = table(spark, sf, "events")
    last = events.agg(F.max("ts").alias("_last"))
    recent = events.crossJoin(F.broadcast(last)).filter(F.col("ts") >= F.date_trunc("day", "_last") - F.expr("interval 7 days"))  # one row
    return aggs.terms(recent, "event_type", 20)


@query(
    "semi_topk_breakdown",
    """WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT o_custkey, o_orderstatus, count(*) AS count FROM orders WHERE o_custkey IN (SELECT o_custkey FROM t) GROUP BY ALL""",
)
def semi_topk_breakdown(spark, sf):
    orders = table(spark, sf, "orders")
    top = aggs.terms(orders, "o_custkey", 10)
    return orders.join(F.broadcast(top), "o_custkey", "left_semi").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("count"))


_DAYS = """WITH l AS (SELECT max(ts)::DATE - 1 AS d FROM events),
c AS (SELECT event_type, count(*) FILTER (ts::DATE < d) AS before, count(*) FILTER (ts::DATE = d) AS after FROM events, l WHERE ts::DATE BETWEEN d - 1 AND d GROUP BY 1)
SELECT event_type, before, after, round(after / nullif(before, 0), 4) AS ratio,
coalesce(before > 0 AND NOT (before < {0} AND after < {0}) AND (round(after / nullif(before, 0), 4) < 0.2 OR round(after / nullif(before, 0), 4) > 3), false) AS alert FROM c"""


@query("day_over_day", _DAYS.format(100))
def day_over_day(spark, sf):
    """The last two whole days: the day of the last event may not be over."""
    events = table(spark, sf, "events")
    last = events.agg((F.date_sub(F.max("ts").cast("date"), 1)).alias("_day"))
    return aggs.day_over_day(events.crossJoin(F.broadcast(last)), "ts", "event_type", F.col("_day"))  # one row


@query(
    "zero_streak",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), g AS (SELECT user_id, d, (d - lag(d) OVER (PARTITION BY user_id ORDER BY d) - 1)::INT AS days FROM d)
SELECT user_id, (d - days)::DATE AS start, days, days >= 3 AS alert FROM g WHERE days > 0""",
)
def zero_streak(spark, sf):
    return aggs.zero_streaks(table(spark, sf, "events"), "ts", "user_id", alert=3)


@query("anti_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_processed(spark, sf):
    return dedup.not_processed(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("first_wins_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents GROUP BY text")
def first_wins_dedup(spark, sf):
    keyed = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return dedup.first_wins(keyed, ["digest"], ["doc_id"])


@query("best_score_dedup", "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) = 1")
def best_score_dedup(spark, sf):
    return dedup.best_wins(table(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id")


@query("last_write_wins", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1")
def last_write_wins(spark, sf):
    return dedup.last_wins(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "event_id")


@query("upsert_idempotent", "SELECT event_id, value + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS value FROM events")
def upsert_idempotent(spark, sf):
    """All events but the purchases are there; clicks are corrected and purchases added, twice."""
    events = table(spark, sf, "events").select("event_id", "ts", "value", "event_type")
    old, new = events.filter("event_type <> 'purchase'"), events.filter("event_type in ('click', 'purchase')")
    new = new.withColumn("value", F.col("value") + F.when(F.col("event_type") == "click", 1).otherwise(0))
    once = dedup.upsert(old, new, "event_id", "ts")
    return dedup.upsert(once, new, "event_id", "ts").select("event_id", "value")


@query("latest_desc_nulls_last", "SELECT event_id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 20")
def latest_desc_nulls_last(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts").orderBy(F.col("ts").desc_nulls_last(), "event_id").limit(20)


@query("top_metric", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_metric(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("top_per_group", "SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 5")
def top_per_group(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return dedup.first_per_group(orders, ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 5)


@query("trend_sorted", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS FIRST, doc_id LIMIT 50")
def trend_sorted(spark, sf):
    both = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return both.orderBy(F.col("quality").asc_nulls_first(), "doc_id").limit(50)


@query(
    "union_all_sources",
    "SELECT 'documents' AS origin, doc_id AS id, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'benchmark', item_id, NULL FROM benchmark UNION ALL SELECT 'pages', page_id, url FROM pages",
)
def union_all_sources(spark, sf):
    part = lambda name, i, *more: table(spark, sf, name).select(F.lit(name).alias("origin"), F.col(i).alias("id"), *more)
    return dedup.union_all(part("documents", "doc_id"), part("benchmark", "item_id"), part("pages", "page_id", "url")).select("origin", "id", "url")


@query(
    "set_ops_tokens",
    r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), q AS (SELECT ['the', 'of', 'zzz'] AS q)
SELECT item_id, len(list_intersect(list_distinct(t), q))::INT AS shared, len(list_distinct(t))::INT AS n_distinct, list_has_any(t, q) AS overlaps, list_has_all(t, q[:2]) AS has_both FROM b, q""",
)
def set_ops_tokens(spark, sf):
    q = F.array(F.lit("the"), F.lit("of"), F.lit("zzz"))
    df = table(spark, sf, "benchmark").select("item_id", tokenize("text").alias("t"))
    return df.select(
        "item_id", F.size(F.array_intersect("t", q)).alias("shared"), F.size(F.array_distinct("t")).alias("n_distinct"),
        F.arrays_overlap("t", q).alias("overlaps"), (F.size(F.array_except(F.slice(q, 1, 2), "t")) == 0).alias("has_both"),
    )


@query(
    "event_hash_rotation",
    "SELECT strftime(ts, '%Y%m%d%H') AS hour, (('0x' || md5(strftime(ts, '%Y%m%d%H'))[25:32])::BIGINT % 30)::INT AS slot, count(*) AS count FROM events GROUP BY ALL",
)
def event_hash_rotation(spark, sf):
    hour, slot = F.date_format("ts", "yyyyMMddHH"), dates.hour_slot("ts", 30)
    return table(spark, sf, "events").groupBy(hour.alias("hour"), slot.alias("slot")).agg(F.count("*").alias("count"))


@query("query_grid", "SELECT r_name, c_mktsegment AS segment FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)")
def query_grid(spark, sf):
    """Every region with every segment: a grid of two dimensions of a fixed size."""
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()
    return table(spark, sf, "region").select("r_name").crossJoin(F.broadcast(segments))


@query("dimension_lookup", "SELECT r_name, c_mktsegment, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def dimension_lookup(spark, sf):
    # nation and region are dimensions of a fixed size
    dims = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf, "customer").join(F.broadcast(dims), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("count"))


@query("file_counters", "SELECT count(*) AS read, count(*) FILTER (length(trim(text)) > 0) AS usable, count(DISTINCT text) AS distinct_texts, (count(*) - count(DISTINCT text))::BIGINT AS duplicates FROM documents")
def file_counters(spark, sf):
    digests = table(spark, sf, "documents").select((F.length(F.trim("text")) > 0).alias("ok"), F.sha2("text", 256).alias("d"))
    by = digests.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("ok"))
    out = by.agg(F.sum("n").alias("read"), F.sum("ok").alias("usable"), F.count("d").alias("distinct_texts"))
    return out.withColumn("duplicates", F.col("read") - F.col("distinct_texts"))
