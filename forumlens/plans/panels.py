"""Dashboard panels, tools over the corpus and their registered long forms."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions import text
from forumlens.operators import aggs, dedup, deltas, filters, inverted, retrieval, sketches
from forumlens.operators.deltas import Panel
from forumlens.plans import search
from forumlens.plans.registry import query
from forumlens.session import fresh_dir, saved, table
from forumlens.sources.sinks import KeyedTable


def overview(orders: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """The panels of the dashboard's first page, each a lazy table of its own."""
    return {
        "priorities": aggs.terms(orders, "o_orderpriority", 10),
        "statuses": aggs.terms(orders, "o_orderstatus", 10),
        "events": aggs.terms(events, "event_type", 10),
        "months": aggs.date_histogram(orders, "o_orderdate", "month", densify=True),
        "metrics": aggs.stats(events, "value", ["event_type"]),
    }


@query(
    "dashboard_overview_long",
    """SELECT 'orders' AS panel, 'o_orderpriority' AS field, o_orderpriority AS key, count(*) AS count FROM orders GROUP BY 3
UNION ALL SELECT 'orders', 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 3 UNION ALL SELECT 'orders', 'total', NULL, count(*) FROM orders
UNION ALL SELECT 'events', 'event_type', event_type, count(*) FROM events GROUP BY 3 UNION ALL SELECT 'events', 'total', NULL, count(*) FROM events""",
)
def dashboard_overview_long(spark, sf):
    """All counts of the first page in one scan of each table."""
    part = lambda name, *keys: aggs.multi_terms(table(spark, sf, name), list(keys)).select(F.lit(name).alias("panel"), F.col("panel").alias("field"), "key", "count")
    return part("orders", "o_orderpriority", "o_orderstatus").union(part("events", "event_type"))


@query(
    "volume_anomaly",
    """WITH l AS (SELECT max(ts)::DATE - 1 AS d FROM events),
c AS (SELECT user_id, count(*) FILTER (ts::DATE < d) AS before, count(*) FILTER (ts::DATE = d) AS after FROM events, l WHERE ts::DATE BETWEEN d - 1 AND d GROUP BY 1)
SELECT user_id, before, after, round(after / nullif(before, 0), 4) AS ratio,
coalesce(before > 0 AND NOT (before < 100 AND after < 100) AND (round(after / nullif(before, 0), 4) < 0.2 OR round(after / nullif(before, 0), 4) > 3), false) AS alert FROM c""",
)
def volume_anomaly(spark, sf):
    events = table(spark, sf, "events")
    last = events.agg(F.date_sub(F.max("ts").cast("date"), 1).alias("_day"))
    return aggs.day_over_day(events.crossJoin(F.broadcast(last)), "ts", "user_id", F.col("_day"))  # one row


@dataclass(frozen=True)
class SearchRequest:
    """A validated search: text of 2 to 500 characters, 1 to 20 results, dates in order."""

    query: str
    top_k: int = 5
    corpus: str | None = None
    region: str | None = None
    start: date | None = None
    end: date | None = None
    platform: str | None = None
    source_group: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "query", " ".join(self.query.split()))
        if not 2 <= len(self.query) <= 500:
            raise ValueError("a query has 2 to 500 characters")
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k is 1 to 20")
        if self.start and self.end and self.start > self.end:
            raise ValueError("the start is after the end")


@dataclass(frozen=True)
class Answer:
    """What a tool found: its figures, and the evidence behind them; both are lazy tables."""

    data: DataFrame
    evidence: DataFrame


#: Columns of a corpus that tools ask for, by what they are to them.
ROLES = ("id", "text", "title", "topic", "corpus", "region", "period", "platform", "source", "sentiment")
#: Those that a search can be limited by.
FACETS = ("corpus", "region", "platform", "source", "period")


class Tools:
    """Read-only questions over a table of documents of two kinds; every answer is a table of figures and one of evidence.

    columns: the name of each role's column; a role without a column filters nothing and is null. A region asked for
    also admits national documents; a period that is null is within every range. index: of the same documents, with the
    facets FACETS; without one each answer reads the texts once, however many questions it asks.
    """

    NAMES = ("search_discussion", "search_official", "aggregate_topic", "compare_regions", "sentiment_trend", "coverage")

    def __init__(self, docs: DataFrame, columns: dict[str, str], discussion: str = "discussion", official: str = "official", national: str = "AU", stopwords: frozenset[str] = retrieval.STOPWORDS, index: inverted.InvertedIndex | None = None):
        kinds = {"period": "date", "sentiment": "double"}
        cols = [(F.col(columns[r]) if r in columns else F.lit(None).cast(kinds.get(r, "string"))).alias(r) for r in ROLES]
        self.docs, self.discussion, self.official, self.national, self.stopwords, self.index = docs.select(*cols), discussion, official, national, stopwords, index

    def call(self, name: str, **arguments) -> Answer:
        if name not in self.NAMES:
            raise ValueError(f"no tool {name!r}")
        return getattr(self, name)(**arguments)

    def _where(self, r: SearchRequest) -> Column:
        out = filters.exact(corpus=r.corpus, platform=r.platform, source=r.source_group) & filters.region_or_national("region", r.region, self.national)
        day = lambda d: F.lit(d) if d else None
        return out & filters.null_tolerant_range("period", day(r.start), day(r.end))

    def _ask(self, requests: list[SearchRequest], top_k: int) -> DataFrame:
        """(question, id, rank, score, snippet): one plan for all requests, numbered in order; all are cut to `top_k`."""
        source = self.index or inverted.Corpus(self.docs, "id", F.concat_ws(" ", "title", "text"), {f: f for f in FACETS})
        regions = lambda r: {"region": (r.region, self.national)} if r.region else {}
        only = lambda r: {f: (v,) for f, v in (("corpus", r.corpus), ("platform", r.platform), ("source", r.source_group)) if v}
        asked = [inverted.Question(r.query, only(r) | regions(r), {"period": (r.start, r.end)} if r.start or r.end else {}) for r in requests]
        return inverted.ask(source, self.docs.select("id", "title", "text"), asked, top_k, "title", self.stopwords)

    def _search(self, corpus: str, query: str, top_k: int = 5, **more) -> DataFrame:
        return self._ask([SearchRequest(query, top_k, corpus, **more)], top_k).drop("question")

    def _about(self, topic: str, *fields: str, **more) -> DataFrame:
        """Discussion that shares any word with the topic, in any of the fields."""
        r = SearchRequest(topic, corpus=self.discussion, **more)
        words = F.array(*map(F.lit, retrieval.tokens_of(r.query))) if retrieval.tokens_of(r.query) else F.array().cast("array<string>")
        return self.docs.filter(self._where(r)).filter(F.arrays_overlap(text.tokenize(F.concat_ws(" ", *fields)), words))

    def search_discussion(self, query: str, **more) -> Answer:
        found = self._search(self.discussion, query, **more)
        return Answer(found.agg(F.count("*").alias("result_count")), found)

    def search_official(self, query: str, **more) -> Answer:
        found = self._search(self.official, query, **more)
        return Answer(found.agg(F.count("*").alias("result_count")), found)

    def aggregate_topic(self, topic: str, region: str | None = None, platform: str | None = None) -> Answer:
        """Counts in all, by platform and by region, in long form, and the three best documents."""
        found = self._about(topic, "topic", "title", "text", region=region, platform=platform)
        return Answer(aggs.multi_terms(found, ["platform", "region"]), self._search(self.discussion, topic, 3, region=region, platform=platform))

    def compare_regions(self, query: str, regions: list[str], start: date | None = None, end: date | None = None) -> Answer:
        """For each of two to four regions how many of the best two documents of each corpus there are."""
        if not 2 <= len(dict.fromkeys(regions)) <= 4:
            raise ValueError("2 to 4 regions can be compared")
        asked = [(r, c) for r in dict.fromkeys(regions) for c in (self.discussion, self.official)]
        found = self._ask([SearchRequest(query, 2, c, region=r, start=start, end=end) for r, c in asked], 2)
        spark = found.sparkSession
        named = spark.createDataFrame([(n, *a) for n, a in enumerate(asked)], "question int, region string, corpus string")
        found = found.join(F.broadcast(named), "question").drop("question")
        every = spark.createDataFrame([(r,) for r in dict.fromkeys(regions)], "region string")
        hits = lambda c: F.count(F.when(F.col("corpus") == c, 1))
        counts = found.groupBy("region").agg(hits(self.discussion).alias("discussion_hits"), hits(self.official).alias("official_hits"))
        return Answer(every.join(counts, "region", "left").na.fill(0), found)

    def sentiment_trend(self, topic: str, region: str | None = None, start: date | None = None, end: date | None = None) -> Answer:
        """A point for each document with a sentiment, by period and id; points without a period come first."""
        found = self._about(topic, "topic", "text", region=region, start=start, end=end).filter("sentiment is not null")
        points = found.select("id", "period", F.col("sentiment").alias("mean_sentiment"), F.lit(1).cast("long").alias("count"))
        return Answer(points.orderBy(F.col("period").asc_nulls_first(), "id"), self._search(self.discussion, topic, 3, region=region, start=start, end=end))

    def coverage(self, corpus: str = "both", region: str | None = None, about: str = "housing") -> Answer:
        """Documents, sources and first and last period; the best document of each corpus."""
        corpora = (self.discussion, self.official) if corpus == "both" else (corpus,)
        docs = self.docs.filter(F.col("corpus").isin(*corpora) & filters.region_or_national("region", region, self.national))
        data = docs.agg(F.count("*").alias("document_count"), F.array_sort(F.collect_set("source")).alias("sources"), F.min("period").alias("date_min"), F.max("period").alias("date_max"))
        return Answer(data, self._ask([SearchRequest(about, 1, c, region=region) for c in corpora], 1).drop("question"))


def tools_over(spark, sf) -> Tools:
    """The tools over `documents`: English is discussion and German official, sources are regions."""
    docs = table(spark, sf, "documents").withColumns({
        "period": F.when(F.col("n_chars") % 9 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 100).cast("int"))),
        "mood": F.when(F.col("n_chars") % 4 != 0, (F.col("n_chars") % 201 - 100) / 100.0),
    })
    return Tools(docs, {"id": "doc_id", "text": "text", "corpus": "lang", "region": "source", "platform": "source", "source": "source", "period": "period", "sentiment": "mood"}, "en", "de", "src0")


_DAY = "CASE WHEN n_chars % 9 <> 0 THEN DATE '2024-01-01' + (n_chars % 100)::INT END"
_MOOD = "CASE WHEN n_chars % 4 <> 0 THEN (n_chars % 201 - 100) / 100.0::DOUBLE END"
_ABOUT = "lang = 'en' AND list_has_any(regexp_extract_all(lower(text), '[a-z0-9]+'), ['mit', 'license'])"


def hits_sql(asked: str, where: str, k: int) -> str:
    """A CTE list whose last, `hits`, has (doc_id, rank, score) of a search."""
    wide, cut = max(4 * k, 20), max(2 * k, 10)
    return search.base_sql(where, asked, wide, cut) + f"hits AS (SELECT doc_id, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank, score FROM re QUALIFY rank <= {k})"


@query("tool_search", hits_sql("apache license", "lang = 'en'", 5) + " SELECT doc_id AS id, rank, score FROM hits")
def tool_search(spark, sf):
    return tools_over(spark, sf).call("search_discussion", query="apache license", top_k=5).evidence.select("id", "rank", "score")


@query(
    "tool_search_filtered",
    hits_sql("the mit license", f"lang = 'de' AND source IN ('src1', 'src0') AND source = 'src1' AND coalesce({_DAY} BETWEEN DATE '2024-01-10' AND DATE '2024-03-20', true)", 4) + " SELECT doc_id AS id, rank, score FROM hits",
)
def tool_search_filtered(spark, sf):
    return tools_over(spark, sf).call("search_official", query="the mit license", top_k=4, region="src1", source_group="src1", start=date(2024, 1, 10), end=date(2024, 3, 20)).evidence.select("id", "rank", "score")


@query(
    "tool_aggregate_topic",
    f"""WITH d AS (SELECT source FROM documents WHERE {_ABOUT} AND source IN ('src1', 'src0'))
SELECT 'platform' AS panel, source AS key, count(*) AS count FROM d GROUP BY 2 UNION ALL SELECT 'region', source, count(*) FROM d GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM d""",
)
def tool_aggregate_topic(spark, sf):
    return tools_over(spark, sf).call("aggregate_topic", topic="MIT license", region="src1").data.select("panel", "key", "count")


def _compared(region: str, lang: str) -> str:
    where = f"lang = '{lang}' AND source IN ('{region}', 'src0') AND coalesce({_DAY} >= DATE '2024-01-15', true)"
    return f"SELECT '{region}' AS region, '{lang}' AS lang, count(*) AS n FROM ({hits_sql('mit license', where, 2)} SELECT * FROM hits)"


@query(
    "compare_two_corpora",
    f"""WITH h AS ({' UNION ALL '.join(_compared(r, c) for r in ('src1', 'src2', 'nowhere') for c in ('en', 'de'))})
SELECT region, (sum(n) FILTER (lang = 'en'))::BIGINT AS discussion_hits, (sum(n) FILTER (lang = 'de'))::BIGINT AS official_hits FROM h GROUP BY 1""",
)
def compare_two_corpora(spark, sf):
    return tools_over(spark, sf).call("compare_regions", query="mit license", regions=["src1", "src2", "nowhere"], start=date(2024, 1, 15)).data


@query(
    "tool_sentiment_trend",
    f"""SELECT doc_id AS id, {_DAY} AS period, {_MOOD} AS mean_sentiment, 1::BIGINT AS count FROM documents
WHERE {_ABOUT} AND {_MOOD} IS NOT NULL AND coalesce({_DAY} <= DATE '2024-03-01', true)""",
)
def tool_sentiment_trend(spark, sf):
    return tools_over(spark, sf).call("sentiment_trend", topic="mit license", end=date(2024, 3, 1)).data


@query(
    "tool_coverage",
    f"""SELECT count(*) AS document_count, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, min({_DAY}) AS date_min, max({_DAY}) AS date_max FROM documents WHERE lang IN ('en', 'de') AND source IN ('src2', 'src0')""",
)
def tool_coverage(spark, sf):
    return tools_over(spark, sf).call("coverage", region="src2").data.withColumn("sources", F.array_join("sources", ","))


@query(
    "evidence_merge",
    search.base_sql() + """h AS (SELECT doc_id, bm25 AS score, 1 AS arrival FROM bm UNION ALL SELECT doc_id, dense, 2 FROM de),
b AS (SELECT doc_id, score FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, arrival) = 1)
SELECT doc_id, score, (row_number() OVER (ORDER BY score DESC, doc_id))::INT AS rank FROM b ORDER BY rank LIMIT 8""",
)
def evidence_merge(spark, sf):
    """The best score of each document over the lists of two retrievers, then the best eight."""
    corpus, docs = search.gated(spark, sf)
    lists = (retrieval.bm25(corpus, docs, search.QUERY, "doc_id"), retrieval.dense(docs, search.QUERY, "doc_id"))
    both = dedup.union_all(*[x.toDF("doc_id", "score").withColumn("arrival", F.lit(n)) for n, x in enumerate(lists, 1)])
    return retrieval.ranked(dedup.best_wins(both, ["doc_id"], "score", "arrival").drop("arrival"), "score", "doc_id", 8)


def _long(panels: dict[str, DataFrame]) -> DataFrame:
    """Panels of (key, value) one below the other, with their names."""
    return dedup.union_all(*[df.toDF("key", "value").select(F.lit(name).alias("panel"), F.col("key").cast("string").alias("key"), F.col("value").cast("double").alias("value")) for name, df in panels.items()])


def _counted(df: DataFrame, c: str) -> DataFrame:
    return aggs.terms(df, c, 20).select(c, "count")


def discourse_and_official(posts: DataFrame, official: DataFrame) -> dict[str, DataFrame]:
    """Panels of public posts and of official rows side by side, without a join; each a lazy table of its own.

    posts: platform, query_keyword, subtopic, region, sentiment, created_at; official: source_group, state, row_type, period.
    """
    out = {"posts": posts.agg(F.lit("all"), F.count("*"))}
    out |= {f"posts by {c}": _counted(posts, c) for c in ("platform", "query_keyword", "subtopic")}
    out["posts by region"] = _counted(posts.filter("region <> 'Other'"), "region")
    out["mean sentiment"] = posts.agg(F.lit("all"), F.round(F.avg("sentiment"), 6))
    out["sentiment by month"] = posts.groupBy(F.date_format("created_at", "yyyy-MM")).agg(F.round(F.avg("sentiment"), 6))
    return out | official_overview(official) | {"official periods": official.groupBy(F.concat_ws(" ", "source_group", "period")).agg(F.count("*"))}


def official_overview(official: DataFrame) -> dict[str, DataFrame]:
    return {"official rows": official.agg(F.lit("all"), F.count("*"))} | {f"official by {c}": _counted(official, c) for c in ("source_group", "row_type", "state")}


def video_panels(videos: DataFrame, least: int = 5, most: int = 15) -> dict[str, DataFrame]:
    """Channels with enough videos, years, likes, the most liked videos, and labels of channels' sentiment.

    videos: channel, created_at, likes, title, comments, sentiment_label.
    """
    channels = videos.groupBy("channel").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "channel").limit(most)
    few = channels.orderBy(F.desc("n"), "channel").limit(10).select("channel")  # at most ten rows
    labels = videos.join(F.broadcast(few), "channel").groupBy(F.concat_ws(" ", "channel", "sentiment_label")).agg(F.count("*"))
    one = lambda c: videos.agg(F.lit("all"), c)
    return {
        "channels": channels, "years": videos.groupBy(F.year("created_at")).agg(F.count("*")), "likes": one(F.sum("likes")), "mean likes": one(F.round(F.avg("likes"), 6)), "most likes": one(F.max("likes")),
        "top videos": videos.select("title", "likes").orderBy(F.desc("likes"), "title").limit(10), "channel sentiment": labels, "units": one(F.count("*") + F.sum("comments")),
    }


_TOP = "SELECT {0}, {1}::VARCHAR, count(*)::DOUBLE FROM {2} GROUP BY {1}"


@query(
    "discourse_vs_official",
    """WITH p AS (SELECT event_type AS platform, event_type AS query_keyword, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS subtopic, CASE WHEN user_id % 3 = 0 THEN 'Other' ELSE 'R' || user_id % 3 END AS region, value / 100 AS sentiment, ts FROM events),
o AS (SELECT o_orderpriority AS source_group, o_orderstatus AS state, 'data' AS row_type, strftime(o_orderdate, '%Y') AS period FROM orders)
SELECT 'posts' AS panel, 'all' AS key, count(*)::DOUBLE AS value FROM p UNION ALL """
    + " UNION ALL ".join(_TOP.format(f"'posts by {c}'", c, "p") for c in ("platform", "query_keyword", "subtopic"))
    + " UNION ALL " + _TOP.format("'posts by region'", "region", "(SELECT * FROM p WHERE region <> 'Other')")
    + " UNION ALL SELECT 'mean sentiment', 'all', round(avg(sentiment), 6) FROM p UNION ALL SELECT 'sentiment by month', strftime(ts, '%Y-%m'), round(avg(sentiment), 6) FROM p GROUP BY 2 UNION ALL SELECT 'official rows', 'all', count(*) FROM o UNION ALL "
    + " UNION ALL ".join(_TOP.format(f"'official by {c}'", c, "o") for c in ("source_group", "row_type", "state"))
    + " UNION ALL SELECT 'official periods', source_group || ' ' || period, count(*) FROM o GROUP BY 2",
)
def discourse_vs_official(spark, sf):
    events, orders = table(spark, sf, "events"), table(spark, sf, "orders")
    third = F.col("user_id") % 3
    posts = events.select(F.col("event_type").alias("platform"), F.col("event_type").alias("query_keyword"), F.when(F.col("value") > 50, "high").otherwise("low").alias("subtopic"), F.when(third == 0, "Other").otherwise(F.concat(F.lit("R"), third)).alias("region"), (F.col("value") / 100).alias("sentiment"), F.col("ts").alias("created_at"))
    official = orders.select(F.col("o_orderpriority").alias("source_group"), F.col("o_orderstatus").alias("state"), F.lit("data").alias("row_type"), F.date_format("o_orderdate", "yyyy").alias("period"))
    return _long(discourse_and_official(posts, official))


@query(
    "video_dashboard",
    """WITH v AS (SELECT c_name AS title, 'C' || c_nationkey AS channel, DATE '2020-01-01' + (c_custkey % 1500)::INT AS created_at, c_custkey * 7 % 1000 AS likes, c_custkey % 4 AS comments, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS l FROM customer),
c AS (SELECT channel, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 15)
SELECT 'channels' AS panel, channel AS key, n::DOUBLE AS value FROM c UNION ALL SELECT 'years', year(created_at)::VARCHAR, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'likes', 'all', sum(likes) FROM v
UNION ALL SELECT 'mean likes', 'all', round(avg(likes), 6) FROM v UNION ALL SELECT 'most likes', 'all', max(likes) FROM v UNION ALL (SELECT 'top videos', title, likes FROM v ORDER BY likes DESC, title LIMIT 10)
UNION ALL SELECT 'channel sentiment', channel || ' ' || l, count(*) FROM v WHERE channel IN (SELECT channel FROM c ORDER BY n DESC, channel LIMIT 10) GROUP BY 2 UNION ALL SELECT 'units', 'all', count(*) + sum(comments) FROM v""",
)
def video_dashboard(spark, sf):
    k = F.col("c_custkey")
    videos = table(spark, sf, "customer").select(
        F.col("c_name").alias("title"), F.concat(F.lit("C"), "c_nationkey").alias("channel"), F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int")).alias("created_at"),
        (k * 7 % 1000).alias("likes"), (k % 4).alias("comments"), F.when(F.col("c_acctbal") > 0, "positive").otherwise("negative").alias("sentiment_label"),
    )
    return _long(video_panels(videos))


def followed_panels() -> dict[str, dict[str, Panel]]:
    """The six panels that are kept up to date, by the table that they follow."""
    c, mood = F.col, {"sentiment": F.col("sentiment")}
    return {
        "posts": {
            "overview": Panel([c("platform"), c("label")], mood), "timeline": Panel([F.to_date("created_at")], mood),
            "cities": Panel([c("region")], mood, c("region") != "Other"), "keywords": Panel([c("keyword")]),
        },
        "official": {"official": Panel([c("source_group"), c("state")], {"value": c("value")})},
        "videos": {"videos": Panel([c("channel"), c("label")], {"likes": c("likes"), "comments": c("comments")})},
    }


def _followed(spark, sf):
    """The rows of the three tables with a key `id` and a stamp `t`, and in which of two batches each comes.

    Every fifth row comes in both batches, and with other values in the second.
    """
    twice = lambda k: F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(2))).when(k % 5 < 3, F.array(F.lit(1))).otherwise(F.array(F.lit(2)))).alias("t")
    k, again = F.col("id"), (F.col("t") == 2) & (F.col("id") % 5 == 0)
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), twice(F.col("event_id")), "user_id", "event_type", "value", "ts")
    sentiment = F.round(F.when(again, -F.col("value")).otherwise(F.col("value")) / 100, 4)
    posts = events.select("id", "t", F.col("event_type").alias("platform"), F.when(F.col("user_id") % 3 == 0, "Other").otherwise(F.concat(F.lit("R"), F.col("user_id") % 3 + again.cast("int"))).alias("region"), F.concat(F.lit("w"), k % 7).alias("keyword"), F.col("ts").alias("created_at"), sentiment.alias("sentiment"), F.when(sentiment > 0.5, "high").otherwise("low").alias("label"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), twice(F.col("o_orderkey")), "o_orderpriority", "o_orderstatus", "o_totalprice")
    official = orders.select("id", "t", F.col("o_orderpriority").alias("source_group"), F.when(again, "corrected").otherwise(F.col("o_orderstatus")).alias("state"), F.col("o_totalprice").cast("decimal(18, 2)").alias("value"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), twice(F.col("c_custkey")), "c_nationkey", "c_acctbal")
    videos = customers.select("id", "t", F.concat(F.lit("C"), "c_nationkey").alias("channel"), F.when(F.col("c_acctbal") > 0, "positive").otherwise("negative").alias("label"), (k * 7 % 1000 + again.cast("int")).alias("likes"), (k % 4).alias("comments"))
    return {"posts": posts, "official": official, "videos": videos}


_PANEL = "SELECT '{0}' AS panel, {1} AS keys, count(*) AS n, {2}::DOUBLE AS total FROM {3} GROUP BY ALL"


@query(
    "panels_by_deltas",
    """WITH p AS (SELECT event_type AS platform, CASE WHEN user_id % 3 = 0 THEN 'Other' ELSE 'R' || (user_id % 3 + (event_id % 5 = 0)::INT) END AS region, 'w' || event_id % 7 AS keyword, ts, round(CASE WHEN event_id % 5 = 0 THEN -value ELSE value END / 100, 4) AS s FROM events),
o AS (SELECT o_orderpriority AS g, CASE WHEN o_orderkey % 5 = 0 THEN 'corrected' ELSE o_orderstatus END AS state, o_totalprice AS value FROM orders),
v AS (SELECT 'C' || c_nationkey AS channel, CASE WHEN c_acctbal > 0 THEN 'positive' ELSE 'negative' END AS label, c_custkey * 7 % 1000 + (c_custkey % 5 = 0)::INT AS likes FROM customer)
"""
    + " UNION ALL ".join([
        _PANEL.format("overview", "platform || '|' || CASE WHEN s > 0.5 THEN 'high' ELSE 'low' END", "round(sum(s), 4)", "p"), _PANEL.format("timeline", "ts::DATE::VARCHAR", "round(sum(s), 4)", "p"),
        _PANEL.format("cities", "region", "round(sum(s), 4)", "p WHERE region <> 'Other'"), _PANEL.format("keywords", "keyword", "0", "p"),
        _PANEL.format("official", "g || '|' || state", "round(sum(value), 4)", "o"), _PANEL.format("videos", "channel || '|' || label", "round(sum(likes), 4)", "v"),
    ]),
)
def panels_by_deltas(spark, sf):
    """Six panels after two batches, of which the second also corrects rows of the first."""
    parts, panels = [], followed_panels()
    for name, rows in _followed(spark, sf).items():
        out, rows = fresh_dir(spark, name), saved(rows)
        target, store = KeyedTable(spark, f"{out}/table", rows.schema, "id", "t"), deltas.PanelStore(spark, f"{out}/panels", panels[name])
        for batch in (1, 2):
            deltas.follow(target, store, rows.filter(F.col("t") == batch))
        parts.append(store.state())
    total = F.coalesce(F.element_at("sums", F.when(F.col("panel") == "official", "value").when(F.col("panel") == "videos", "likes").otherwise("sentiment")), F.lit(0))
    return dedup.union_all(*parts).select("panel", F.array_join("keys", "|").alias("keys"), "n", F.round(total, 4).cast("double").alias("total"))


@query(
    "sketches_over_days",
    """SELECT event_type, count(*) AS n, true AS members_near, true AS quantiles_near FROM events WHERE ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-20' GROUP BY 1""",
)
def sketches_over_days(spark, sf):
    """Whether the merged sketches of eighteen days are as near to the exact answers as they promise."""
    events, start, end, points = table(spark, sf, "events"), date(2024, 1, 3), date(2024, 1, 20), [0.5, 0.95]
    days = saved(sketches.daily(events, "ts", ["event_type"], "user_id", "value"))
    merged = sketches.over(days, ["event_type"], points, start, end)
    inside = events.filter(filters.date_range("ts", start, end)).join(F.broadcast(merged), "event_type")  # a row an event type
    below = lambda i: F.avg((F.col("value") <= F.col("quantiles")[i]).cast("double"))
    exact = inside.groupBy("event_type").agg(F.first("n").alias("n"), F.first("members").alias("members"), F.countDistinct("user_id").alias("users"), below(0).alias("b0"), below(1).alias("b1"))
    near = [F.abs(F.col(f"b{i}") - q) <= 2 * sketches.RANK_ERROR for i, q in enumerate(points)]
    return exact.select("event_type", "n", (F.abs(F.col("members") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * sketches.distinct_error())).alias("members_near"), (near[0] & near[1]).alias("quantiles_near"))
