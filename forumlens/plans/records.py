"""Registered queries over raw records, which are made of the tables and written as files, with their DuckDB equivalents."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forumlens.functions import pii, text
from forumlens.operators import dedup, evaluation, filters, normalise, retrieval, sentiment
from forumlens.plans.registry import query
from forumlens.session import fresh_dir, saved, table
from forumlens.sources import readers, sinks


def _posts(spark: SparkSession, records: DataFrame) -> DataFrame:
    """The canonical posts of a column `record` of structs, by way of JSON lines in the shared folder."""
    path = fresh_dir(spark, "records")
    records.select(F.to_json("record").alias("value")).write.text(path)
    return normalise.normalise_posts(readers.read_objects(spark, path))


def _safe(prefix: str, raw: str) -> str:
    """The SQL of a safe id of a short raw value without white space."""
    return rf"'{prefix}_' || regexp_replace(regexp_replace({raw}, '[/:]', '_', 'g'), '[^A-Za-z0-9._-]', '_', 'g')"


@query(
    "posts_bluesky",
    rf"""SELECT {_safe('bluesky', "'at://' || source || '/' || doc_id")} AS doc_id, 'bluesky' AS platform, source, lang AS query_keyword, text, '2024-03-01T10:00:00Z' AS created_at, '2024-03-02T00:00:00Z' AS collected_at,
'at://' || source || '/' || doc_id AS url, 'australia' AS city_context, 'housing' AS topic, 'group ' || lang AS australia_connection, 'bluesky_post' AS content_type, n_chars AS like_count FROM documents WHERE length(trim(text)) > 0""",
)
def posts_bluesky(spark, sf):
    post = F.struct(F.concat(F.lit("at://"), "source", F.lit("/"), "doc_id").alias("uri"), F.col("source").alias("author_handle"), F.lit("2024-03-01T10:00:00Z").alias("created_at"), "text", F.col("n_chars").alias("like_count"))
    record = F.struct(F.lit("bluesky").alias("platform"), F.col("lang").alias("search_query"), F.concat(F.lit("group "), "lang").alias("query_group"), F.lit("20240302").alias("harvested_at"), post.alias("post"))
    out = _posts(spark, table(spark, sf, "documents").select(record.alias("record")))
    return out.select("doc_id", "platform", "source", "query_keyword", "text", "created_at", "collected_at", "url", "city_context", "topic", "australia_connection", "content_type", "like_count")


def redacted_sql(c: str) -> str:
    """What pii.redact() is defined to do, without looking around: what stands before and after is captured."""
    before = r"(^|[^\pL\pN_])"
    c = rf"regexp_replace({c}, '(?i){before}([A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{{2,}})\b', '\1[EMAIL]', 'g')"
    c = rf"regexp_replace({c}, '(^|[^0-9])(?:\+?61[ -]?|0)[2-478](?:[ -]?[0-9]){{8}}($|[^0-9])', '\1[PHONE]\2', 'g')"
    c = rf"regexp_replace({c}, '{before}@[A-Za-z0-9_.-]+', '\1[HANDLE]', 'g')"
    return rf"regexp_replace({c}, '(?i)https?://[^ \t\n\r\f\x0B]+', '[URL]', 'g')"


_SP = r"[ \t\n\r\f\x0B]+"
_BARE = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
for _n, _c in text.ENTITIES:
    _BARE = f"replace({_BARE}, '{_n}', '{_c if _c != chr(39) else chr(39) * 2}')"
_BARE = f"trim(regexp_replace({_BARE}, '{_SP}', ' ', 'g'))"


@query(
    "posts_mastodon",
    rf"""SELECT {_safe('mastodon', "'m/' || page_id")} AS doc_id, 'mastodon' AS platform, 'm.example' AS source, 'rent' AS query_keyword, {_BARE} AS text, '2024-03-01T12:30:00Z' AS created_at, url,
'VIC' AS city_context, 'hashtag' AS australia_connection, 0::BIGINT AS like_count FROM pages WHERE length({_BARE}) > 0""",
)
def posts_mastodon(spark, sf):
    status = F.struct(F.concat(F.lit("m/"), "page_id").alias("uri"), "url", F.col("html").alias("content"), F.lit("20240301123000").alias("created_at"), F.lit("many").alias("favourites_count"))
    record = F.struct(F.lit("mastodon").alias("platform"), F.lit("m.example").alias("instance"), F.lit("rent").alias("search_hashtag"), F.lit("hashtag").alias("query_kind"), F.lit("VIC").alias("filter_region"), status.alias("status"))
    return _posts(spark, table(spark, sf, "pages").select(record.alias("record"))).select("doc_id", "platform", "source", "query_keyword", "text", "created_at", "url", "city_context", "australia_connection", "like_count")


@query(
    "posts_news",
    rf"""WITH p AS (SELECT page_id, page_id % 3 AS k, 'n' || page_id AS url FROM pages)
SELECT {_safe('gdelt_doc', 'url')} AS doc_id, 'gdelt_doc' AS platform, 'n.example' AS source, CASE k WHEN 0 THEN 'rents' WHEN 1 THEN 'econ_housing' ELSE 'gdelt' END AS query_keyword,
CASE k WHEN 2 THEN 'News metadata. Source: n.example. Locations: Perth, Australia, Lima, A, B, C, D. URL: ' || url || '.' ELSE 'Title ' || page_id END AS text, '2024-03-01T12:00:00Z' AS created_at,
CASE k WHEN 2 THEN 'Perth, Australia, Lima, A, B, C' ELSE 'australia' END AS city_context, CASE k WHEN 2 THEN 'location_mentions_australia' WHEN 1 THEN 'NZ' ELSE 'Australia' END AS australia_connection FROM p""",
)
def posts_news(spark, sf):
    """Articles by three shapes: a search's, one with themes, and one that is places only."""
    k = F.col("page_id") % 3
    title = F.when(k != 2, F.concat(F.lit("Title "), "page_id"))
    places = F.when(k == 2, F.array(*[F.struct(F.lit(n).alias("full_name")) for n in ("Perth, Australia", "Lima", "A", "B", "C", "D")]))
    record = F.struct(
        F.when(k == 0, "gdelt_doc").alias("platform"), F.when(k == 0, "rents").alias("search_query"), F.struct(F.concat(F.lit("n"), "page_id").alias("url"), title.alias("title"), F.lit("n.example").alias("domain"), F.lit("20240301T120000Z").alias("seendate")).alias("article"),
        F.when(k == 1, F.array(F.lit("ECON_HOUSING"), F.lit("RENT"))).alias("themes"), F.when(k == 1, "NZ").alias("sourcecountry"), places.alias("locations"),
    )
    return _posts(spark, table(spark, sf, "pages").select(record.alias("record"))).select("doc_id", "platform", "source", "query_keyword", "text", "created_at", "city_context", "australia_connection")


@query(
    "posts_video",
    r"""WITH c AS (SELECT conv_id, list(trim(text) ORDER BY turn, text) AS t, list(role ORDER BY turn, text) AS r FROM conversations GROUP BY 1)
SELECT 'youtube_v' || conv_id AS doc_id, 'youtube' AS platform, 'C' || conv_id % 7 AS source, 'tenancy' AS query_keyword, 'Video ' || conv_id AS title,
trim('Video ' || conv_id || chr(10) || 'Tags: ' || array_to_string(r, ' ') || chr(10) || 'Comments: ' || array_to_string(list_filter(t, lambda x: x <> '')[1:20], ' ')) AS text, '2024-03-01T00:00:00Z' AS created_at,
'https://www.youtube.com/watch?v=v' || conv_id AS url, CASE WHEN conv_id % 2 = 0 THEN 'australia' ELSE 'NZ' END AS city_context, CASE WHEN conv_id % 2 = 0 THEN 'youtube_search_region_AU' ELSE 'youtube_housing_search' END AS australia_connection,
'v' || conv_id AS video_id, (conv_id * 3)::BIGINT AS like_count FROM c""",
)
def posts_video(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("t"))
    comments = F.transform("t", lambda x: F.struct(x["text"].alias("textDisplay")))
    video = F.struct(F.concat(F.lit("v"), "conv_id").alias("id"), F.concat(F.lit("Video "), "conv_id").alias("title"), F.lit("2024-03-01T00:00:00Z").alias("publishedAt"), F.concat(F.lit("C"), F.col("conv_id") % 7).alias("channelTitle"), F.transform("t", lambda x: x["role"]).alias("tags"), (F.col("conv_id") * 3).cast("string").alias("likeCount"))
    asked = F.array(F.struct(F.lit("tenancy").alias("query"), F.when(F.col("conv_id") % 2 == 0, "AU").otherwise("NZ").alias("region_code")))
    out = _posts(spark, turns.select(F.struct(video.alias("video"), asked.alias("search_queries"), comments.alias("comments")).alias("record")))
    return out.select("doc_id", "platform", "source", "query_keyword", "title", "text", "created_at", "url", "city_context", "australia_connection", "video_id", "like_count")


@query(
    "posts_whole",
    """SELECT 'post_e' || event_id AS doc_id, event_type AS platform, props AS text, strftime(ts, '%Y-%m-%d') AS created_at, 'australia' AS city_context, 'housing' AS topic, 'unknown' AS australia_connection,
CASE WHEN event_id % 2 = 0 THEN 'note' END AS content_type, (event_id % 5)::BIGINT AS like_count FROM events""",
)
def posts_whole(spark, sf):
    """Records that are posts already: what is missing gets its default, and listed further fields survive."""
    record = F.struct(F.concat(F.lit("e"), "event_id").alias("doc_id"), F.col("event_type").alias("platform"), F.col("props").alias("text"), F.date_format("ts", "yyyy-MM-dd").alias("created_at"), F.lit("").alias("topic"), F.when(F.col("event_id") % 2 == 0, "note").alias("content_type"), (F.col("event_id") % 5).alias("like_count"), F.lit(1).alias("unlisted"))
    return _posts(spark, table(spark, sf, "events").select(record.alias("record"))).select("doc_id", "platform", "text", "created_at", "city_context", "topic", "australia_connection", "content_type", "like_count")


@query(
    "posts_enriched",
    rf"""WITH d AS (SELECT doc_id, source, text, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+', ' ', 'g'), '@[\pL\pN_]+', ' ', 'g'), '#', ''), '[^A-Za-z0-9 .,!?$%''\-]', ' ', 'g'), '{_SP}', ' ', 'g')) AS c FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)),
w AS (SELECT *, regexp_extract_all(lower(c), '[a-zA-Z'']+') AS w FROM d),
s AS (SELECT *, round(0.65 * (CASE WHEN len(w) = 0 THEN 0 ELSE greatest(-1, least(1, (len(list_filter(w, lambda x: x = 'license')) * 0.5::DOUBLE) / greatest(1, ln(len(w) + 1)))) END), 4)::DOUBLE AS sentiment FROM w)
SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' ELSE 'general' END AS subtopic, CASE WHEN source = 'src1' THEN 'one' ELSE 'Other' END AS region, sentiment,
CASE WHEN sentiment >= 0.04 THEN 'positive' WHEN sentiment <= -0.04 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM s""",
)
def posts_enriched(spark, sf):
    docs = table(spark, sf, "documents")
    posts = docs.select("doc_id", F.lit("bluesky").alias("platform"), F.lit("").alias("query_keyword"), F.lit(None).cast("string").alias("title"), "text", F.col("source").alias("city_context"))
    lex = sentiment.Lexicon(positive_words={"license": 0.5})
    return normalise.enrich(posts, [("legal", "license")], [("one", "^src1$")], lex).select("doc_id", "subtopic", "region", "sentiment", "sentiment_label")


@query(
    "live_news_rows",
    """WITH p AS (SELECT page_id, page_id % 2 = 0 AS place, page_id % 5 = 0 AS own FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'econ_housing' ELSE 'wb_1' END AS query_keyword, 'News: https://x.org/' || page_id || '. Themes: ' || CASE WHEN page_id % 3 = 0 THEN 'ECON_HOUSING;T2' ELSE 'WB_1' END AS text, '2024-03-01T00:00:00Z' AS created_at,
concat_ws(', ', CASE WHEN page_id % 3 = 0 THEN 'theme' END, CASE WHEN place THEN 'location' END, CASE WHEN own THEN 'domain' END) AS filter_reason FROM p WHERE page_id % 3 = 0 OR place OR own""",
)
def live_news_rows(spark, sf):
    k = F.col("page_id")
    rows = table(spark, sf, "pages").select(
        F.when(k % 5 == 0, "news.com.au").otherwise("news.com").alias("source"), F.lit("20240301000000").alias("stamp"), F.concat(F.lit("https://x.org/"), k).alias("url"),
        F.when(k % 3 == 0, "ECON_HOUSING; T2 ;").otherwise("WB_1").alias("themes"), F.lit(None).cast("string").alias("v2_themes"), F.when(k % 2 == 0, "1#Australia#AS").otherwise("1#Peru#PE").alias("locations"),
    )
    out = normalise.live_news(rows, "HOUSING", lambda c: c.contains("#Australia#"))
    return out.select(F.split_part("url", F.lit("/"), F.lit(4)).cast("bigint").alias("page_id"), "query_keyword", "text", "created_at", "filter_reason")


@query(
    "news_from_zips",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, 'https://' || regexp_extract(url, '://([^/]+)', 1) || '/n' || page_id AS link, page_id % 11 <> 0 AS whole, page_id % 3 = 0 AS hit FROM pages WHERE page_id % 7 <> 0),
t AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'WB_' || page_id % 5 END AS one, CASE WHEN whole AND hit THEN 'ECON_HOUSING_PRICES' END AS two, whole AND page_id % 5 = 0 AS near FROM p)
SELECT page_id, host AS source, link AS title, 'News: ' || link || '. Themes: ' || concat_ws(';', nullif(one, ''), two) AS text, lower(coalesce(nullif(one, ''), two, 'gdelt')) AS query_keyword, '2024-02-01T10:00:00Z' AS created_at,
concat_ws(', ', CASE WHEN two IS NOT NULL THEN 'theme' END, CASE WHEN near THEN 'location' END, CASE WHEN host LIKE '%.net' THEN 'domain' END) AS filter_reason
FROM t WHERE two IS NOT NULL OR near OR host LIKE '%.net'""",
)
def news_from_zips(spark, sf):
    """Pages as rows of a feed in zips, a zip a batch: some with too few columns, some without the last two."""
    k, host = F.col("page_id"), F.regexp_extract("url", "://([^/]+)", 1)
    cells = [F.concat(F.lit("r"), k), F.lit("20240201100000"), F.lit("1"), host, F.concat(F.lit("https://"), host, F.lit("/n"), k), F.lit(""), F.lit(""), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("WB_"), k % 5))]
    last = [F.when(k % 3 == 0, "ECON_HOUSING_PRICES").otherwise(""), F.when(k % 5 == 0, "1#Australia#AS").otherwise("1#Peru#PE")]
    short, whole = F.array_join(F.array(*cells), "\t"), F.array_join(F.array(*cells, *last), "\t")
    lines = table(spark, sf, "pages").select(F.when(k % 7 == 0, F.concat(F.lit("r"), k, F.lit("\tshort"))).when(k % 11 == 0, short).otherwise(whole).alias("line"))

    def pack(batches):
        for b in batches:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr("rows.csv", "\n".join(b["line"]))
            yield pd.DataFrame({"path": ["rows.zip"], "content": [held.getvalue()]})

    rows = readers.unzipped_rows(saved(lines.mapInPandas(pack, "path string, content binary")))
    out = normalise.live_news(rows, "HOUSING", lambda c: c.contains("#Australia#"), ".net")
    number = F.regexp_extract("url", "/n([0-9]+)$", 1).cast("bigint").alias("page_id")
    return out.select(number, "source", "title", "text", "query_keyword", "created_at", "filter_reason")


@query(
    "evidence_of_hits",
    """SELECT doc_id::VARCHAR AS doc_id, 'Untitled evidence' AS title, text, source, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'AU' END AS region, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE DATE '2024-01-01' + (doc_id % 300)::INT END AS period,
'housing' AS topic, CASE WHEN source = 'src1' THEN 'official' ELSE 'youtube' END AS platform FROM documents""",
)
def evidence_of_hits(spark, sf):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    hits = table(spark, sf, "documents").select("doc_id", "text", F.lit("").alias("source"), F.col("source").alias("source_group"), F.col("lang").alias("state"), F.when(F.col("doc_id") % 4 == 0, "soon").otherwise(day).alias("created_at"), F.when(F.col("source") == "src1", "elsewhere").otherwise("youtube").alias("platform"))
    return retrieval.coerce_hits(hits, ["en", "de"])


@query(
    "official_rows_whole",
    """SELECT s_suppkey, 'official_trade_' || n || '-2024-03.csv_' || s_suppkey AS doc_id, 'trade' AS source_group, '2024-03' AS period, CASE WHEN n = 3 THEN 'NSW' ELSE 'AU' END AS region,
CASE WHEN s_suppkey % 5 = 0 THEN 'note' ELSE 'data' END AS row_type, s_name AS row_label, 1 AS numeric_count, concat_ws(' | ', CASE WHEN s_suppkey % 5 = 0 THEN 'a: Note: revised' END, 'name: ' || s_name, 'rent: 1,' || s_nationkey + 100) AS text
FROM (SELECT *, s_nationkey AS n FROM supplier) WHERE s_nationkey <> 4""".replace("'official_trade_' || n || '-2024-03.csv_'", "'official_trade_' || CASE WHEN n = 3 THEN 'nsw_' ELSE 'x' END || n || '_2024-03.csv_'"),
)
def official_rows_whole(spark, sf):
    n = F.col("s_nationkey")
    file = F.when(n == 4, F.concat(F.lit("trade/manifest_"), n)).otherwise(F.concat(F.lit("trade/"), F.when(n == 3, "nsw_").otherwise("x"), n, F.lit("_2024-03.csv")))
    data = F.create_map(F.lit("name"), "s_name", F.lit("rent"), F.concat(F.lit("1,"), n + 100), F.lit("gap"), F.lit(" NaN "), F.lit("a"), F.when(F.col("s_suppkey") % 5 == 0, "Note: revised").otherwise("none"))
    rows = table(spark, sf, "supplier").select(file.alias("source_file"), F.col("s_suppkey").alias("record_index"), data.alias("data"))
    out = normalise.official_rows(rows)
    return out.select(F.element_at(F.split("doc_id", "_"), -1).cast("bigint").alias("s_suppkey"), "doc_id", "source_group", "period", "region", "row_type", "row_label", "numeric_count", "text")


@query(
    "official_rows_capped_unique",
    "SELECT count(*) AS rows, count(DISTINCT seg) AS segments FROM (SELECT c_mktsegment AS seg FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 3) WHERE true",
)
def official_rows_capped_unique(spark, sf):
    """With a cap of three rows a file; with and without deduplication of equal texts."""
    rows = table(spark, sf, "customer").select(F.concat(F.lit("seg/"), "c_nationkey", F.lit(".csv")).alias("source_file"), F.col("c_custkey").alias("record_index"), F.create_map(F.lit("segment"), "c_mktsegment").alias("data"))
    every, unique = (normalise.official_rows(rows, most=3, unique=u).groupBy().count() for u in (False, True))
    return every.withColumnRenamed("count", "rows").crossJoin(unique.withColumnRenamed("count", "segments"))  # one row each


@query("json_lines_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM customer) AS written FROM customer")
def json_lines_round_trip(spark, sf):
    path, df = fresh_dir(spark, "lines"), table(spark, sf, "customer")
    n = sinks.write_jsonl(df, path, ["c_custkey"])
    return readers.read_jsonl(spark, path, df.schema).withColumn("written", F.lit(n).cast("bigint"))


@query("json_lines_permissive", "SELECT count(*) AS rows, count(*) FILTER (c_custkey % 7 = 0) AS bad, sum(CASE WHEN c_custkey % 7 <> 0 THEN c_custkey END)::BIGINT AS total FROM customer")
def json_lines_permissive(spark, sf):
    path, k = fresh_dir(spark, "lines"), F.col("c_custkey")
    table(spark, sf, "customer").select(F.when(k % 7 == 0, F.concat(F.lit("{oops "), k)).otherwise(F.to_json(F.struct("c_custkey"))).alias("value")).write.text(path)
    got = readers.read_jsonl(spark, path, "c_custkey long", "PERMISSIVE").select("c_custkey", F.col("_corrupt_record").isNotNull().alias("bad"))
    return got.agg(F.count("*").alias("rows"), F.count(F.when(F.col("bad"), 1)).alias("bad"), F.sum("c_custkey").alias("total"))


@query("line_counters", "SELECT count(*) FILTER (c_custkey % 11 <> 0) AS read, count(*) FILTER (c_custkey % 11 NOT IN (0, 1)) AS usable, count(*) FILTER (c_custkey % 11 = 1) AS not_json, count(*) FILTER (c_custkey % 11 = 2) AS not_object, count(*) FILTER (c_custkey % 11 NOT IN (0, 1, 2)) AS objects FROM customer")
def line_counters(spark, sf):
    """What a reader makes of good lines, blank ones, bad ones and JSON that is no object."""
    path, k = fresh_dir(spark, "lines"), F.col("c_custkey") % 11
    table(spark, sf, "customer").select(F.when(k == 0, "  ").when(k == 1, "{bad").when(k == 2, "[1]").otherwise(F.to_json(F.struct("c_custkey"))).alias("value")).write.text(path)
    counts = readers.count_bad_lines(spark, path).agg(*[F.sum(c).alias(c) for c in ("read", "usable", "not_json", "not_object")])
    objects = readers.read_objects(spark, path).agg(F.count("*").alias("objects"))
    return counts.crossJoin(objects)  # one row each


@query("line_numbers", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line FROM orders")
def line_numbers(spark, sf):
    """The lines of one large text in parts are numbered from its first to its last, however the parts are split."""
    path = fresh_dir(spark, "lines")
    orders = table(spark, sf, "orders").select("o_orderkey")
    orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    lines = readers.numbered_lines(spark, path, through=True)
    return lines.select(F.col("value").cast("bigint").alias("o_orderkey"), "line")


@query("json_array", "SELECT n_nationkey, n_name FROM nation")
def json_array(spark, sf):
    path, one = fresh_dir(spark, "array"), F.struct("n_nationkey", "n_name")
    table(spark, sf, "nation").agg(F.to_json(F.collect_list(one)).alias("value")).coalesce(1).write.text(path)  # a dimension of a fixed size
    return readers.read_json_array(spark, path, "n_nationkey int, n_name string")


def _by_day(spark: SparkSession, sf: str) -> str:
    path = fresh_dir(spark, "days")
    days = table(spark, sf, "events").select(F.date_format("ts", "yyyyMMdd000000").alias("stamp"), F.lit("x").alias("value"))
    days.distinct().write.partitionBy("stamp").text(path)
    return path


@query("files_by_day", "SELECT DISTINCT strftime(ts, '%Y%m%d000000') AS stamp FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def files_by_day(spark, sf):
    return readers.list_files(spark, [_by_day(spark, sf)], "*.txt", "20240105", "20240120", ("^normalised_", "official")).select("stamp").distinct()


@query("latest_day_file", "SELECT strftime(max(ts), '%Y%m%d000000') AS stamp FROM events")
def latest_day_file(spark, sf):
    return readers.latest_file(readers.list_files(spark, _by_day(spark, sf), "*.txt")).select("stamp")


@query("panel_lookup", "SELECT o_orderpriority, count(*) AS count FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def panel_lookup(spark, sf):
    """Panels are written, one is read again, and of it one key."""
    path = fresh_dir(spark, "panels")
    sinks.refresh_panels({"priorities": table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("count"))}, path)
    return sinks.read_panel(spark, path, "priorities", o_orderpriority="1-URGENT")


@query("cap_per_source", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5")
def cap_per_source(spark, sf):
    return dedup.first_per_group(table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


_RIGHT = "l_linestatus = o_orderstatus AND (l_tax < 0.04 OR o_totalprice < 200000)"


@query(
    "task_outcomes",
    f"""WITH j AS (SELECT *, {_RIGHT} AS ok, CASE WHEN l_linenumber = 1 THEN 'completed' ELSE l_linestatus END AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag AS variant, count(*) AS task_count, round(avg((CASE WHEN l_linenumber = 1 THEN false ELSE ok END)::INT), 6)::DOUBLE AS task_success, round(avg((l_discount < 0.05)::INT), 6)::DOUBLE AS argument_validity,
round(avg((l_tax > 0.02)::INT) FILTER (l_linenumber > 2), 6)::DOUBLE AS tool_execution_success, round(sum(least(l_linenumber - 1, 3))::DOUBLE / sum(CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END), 6)::DOUBLE AS tool_attempt_success,
round(avg((l_quantity > 10)::INT) FILTER (l_linenumber = 1), 6)::DOUBLE AS citation_completeness, round(avg((l_discount > 0.02)::INT) FILTER (o_totalprice > 100000), 6)::DOUBLE AS failure_recovery,
round(avg(CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 0 END), 6)::DOUBLE AS average_tool_calls, round(quantile_cont(l_extendedprice, 0.5), 6)::DOUBLE AS p50_latency_ms, round(quantile_disc(l_extendedprice, 0.95), 6)::DOUBLE AS p95_latency_ms FROM j GROUP BY 1""",
)
def task_outcomes(spark, sf):
    tools = F.when(F.col("o_totalprice") < 200000, F.array().cast("array<string>")).otherwise(F.array(F.lit("search")))
    tasks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("expected_status"), tools.alias("expected_tools"), (F.col("o_totalprice") > 100000).alias("faulted"))
    n = F.col("l_linenumber")
    outcomes = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("variant"), F.when(n == 1, "completed").otherwise(F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_tax") < 0.04, F.array(F.lit("search"), F.lit("trend"))).otherwise(F.array(F.lit("trend"))).alias("tools"), (F.col("l_discount") < 0.05).alias("argument_valid"), F.when(n > 2, n).otherwise(0).alias("tool_total"),
        F.least(n - 1, F.lit(3)).alias("tool_success"), (F.col("l_tax") > 0.02).alias("logical_tool_success"), F.when(F.col("l_quantity") > 10, 1).otherwise(0).alias("citations"), (F.col("l_discount") > 0.02).alias("recovered"), F.col("l_extendedprice").alias("latency_ms"),
    )
    return evaluation.summarise(evaluation.judged(tasks, outcomes))


@query("public_posts", f"SELECT sha256('pepper:' || page_id)[1:24] AS public_id, 'web' AS platform, {redacted_sql('url')}[1:500] AS title, {redacted_sql('html')}[1:10000] AS text FROM pages")
def public_posts(spark, sf):
    pages = table(spark, sf, "pages").withColumn("platform", F.lit("web"))
    return pii.public_record(pages, "pepper", "page_id", "html", "url", "platform", fall_back=False)


@query("flagged_rows", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def flagged_rows(spark, sf):
    flagged = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("relevant")).filter("relevant")
    return table(spark, sf, "documents").select("doc_id").join(flagged, "doc_id").select("doc_id")


@query("region_token_in_content", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), 'src2')")
def region_token_in_content(spark, sf):
    return table(spark, sf, "documents").filter(filters.contains_ci(F.concat_ws(" ", "text", "source"), "SRC2")).select("doc_id")
