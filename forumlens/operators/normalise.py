"""Raw feed records to canonical posts, and sparse official rows to searchable rows.

Records come as VARIANT, so that each source's own keys can be probed; every branch is a projection, and a record goes
to the first branch that knows its shape. Empty text counts as missing all along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions import dates, rules, text
from forumlens.operators import dedup, filters
from forumlens.operators import sentiment as mood

#: Columns of a post, all text but for like_count. What only some feeds carry comes last.
POST = ("doc_id", "platform", "source", "query_keyword", "title", "text", "created_at", "collected_at", "url", "city_context", "topic", "australia_connection", "content_type", "parent_id", "video_id", "channel_title", "like_count", "raw_metadata")
#: What stands for a missing context, topic or connection, and the content type of each feed.
REGION, TOPIC, UNKNOWN, COUNTRY = "australia", "housing", "unknown", "Australia"
CONTENT = {"bluesky": "bluesky_post", "mastodon": "mastodon_post", "youtube": "youtube_video", "gdelt": "gdelt_article"}


def _get(record: str, *paths: str) -> Column:
    return text.first_non_empty(*[F.try_variant_get(record, p, "string") for p in paths])


def platform_of(record: str = "record") -> Column:
    """The branch of a record: full posts first, then the declared platform, then the keys that are there."""
    has = lambda p: F.try_variant_get(record, p, "variant").isNotNull()
    named = F.lower(F.coalesce(_get(record, "$.platform"), F.lit("")))
    full = has("$.doc_id") & has("$.platform") & has("$.text") & has("$.created_at")
    return (
        F.when(full, "base").when(named.isin("bluesky", "mastodon", "youtube"), named).when(named.startswith("gdelt"), "gdelt")
        .when(has("$.article") | has("$.themes"), "gdelt").when(has("$.video"), "youtube")
    )


def _items(record: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, path, "array<variant>"), F.array().cast("array<variant>"))


def _any(v: Column, *paths: str) -> Column:
    return text.first_non_empty(*[F.trim(F.try_variant_get(v, p, "string")) for p in paths])


def comments_text(record: str, most: int = 20) -> Column:
    """The first `most` comments that are not blank, joined by spaces."""
    texts = F.transform(_items(record, "$.comments"), lambda c: _any(c, "$.text", "$.textDisplay", "$.textOriginal", "$.comment_text"))
    return F.array_join(F.slice(F.array_compact(texts), 1, most), " ")


def location_names(record: str = "record") -> Column:
    """The full names of a news record's locations, in order."""
    return F.array_compact(F.transform(_items(record, "$.locations"), lambda x: _any(x, "$.full_name")))


def _news_fallback(r: str, source: Column, url: Column) -> Column:
    """A sentence of what is known of an article without a text; parts that are missing are left out."""
    themes = text.non_empty(F.array_join(F.coalesce(F.try_variant_get(r, "$.themes", "array<string>"), F.array(_get(r, "$.themes"))), ", "))
    part = lambda name, c: F.concat(F.lit(f"{name}: "), text.non_empty(c), F.lit("."))
    places = F.array_join(location_names(r), ", ")
    return F.concat_ws(" ", F.lit("News metadata."), part("Source", source), part("Themes", themes), part("All themes", _get(r, "$.all_themes")), part("Locations", places), part("URL", url))


def _news_keyword(r: str) -> Column:
    """The search's words, else the first theme, as readable words."""
    first = text.first_non_empty(F.try_variant_get(r, "$.themes[0]", "string"), F.trim(F.split_part(_get(r, "$.all_themes"), F.lit(";"), F.lit(1))))
    said = _get(r, "$.search_query", "$.query_keyword", "$.query")
    return text.humanise_code(F.coalesce(said, F.lower(first), F.lit("gdelt")))


def _branch(df: DataFrame, kind: str) -> DataFrame:
    r = "record"
    g = lambda *p: _get(r, *p)
    if kind == "base":
        cols = {c: g(f"$.{c}") for c in POST} | {"doc_id": text.safe_doc_id(g("$.doc_id"), "post")}
        cols["raw_metadata"] = F.to_json(F.try_variant_get(r, "$.raw_metadata", "variant"))
    elif kind == "bluesky":
        cols = {"doc_id": text.safe_doc_id(g("$.post.uri", "$.post.cid"), kind), "query_keyword": g("$.search_query", "$.query_keyword"), "text": g("$.post.text"), "created_at": g("$.post.created_at"), "collected_at": g("$.harvested_at"), "url": g("$.post.uri"), "source": g("$.post.author_handle"), "australia_connection": g("$.query_group"), "like_count": g("$.post.like_count")}
    elif kind == "mastodon":
        cols = {"doc_id": text.safe_doc_id(g("$.status.uri", "$.status.id"), kind), "query_keyword": g("$.search_hashtag", "$.query_keyword"), "text": text.strip_html(g("$.status.content")), "created_at": g("$.status.created_at"), "collected_at": g("$.harvested_at"), "url": g("$.status.url", "$.status.uri"), "source": g("$.instance"), "city_context": g("$.filter_region"), "australia_connection": g("$.query_kind"), "like_count": g("$.status.favourites_count")}
    elif kind == "youtube":
        tags = F.array_join(F.coalesce(F.try_variant_get(r, "$.video.tags", "array<string>"), F.array().cast("array<string>")), " ")
        parts = [g("$.video.title"), g("$.video.description"), F.concat(F.lit("Tags: "), text.non_empty(tags)), F.concat(F.lit("Comments: "), text.non_empty(comments_text(r)))]
        code = F.coalesce(g("$.search_queries[0].region_code"), F.lit(""))
        cols = {"doc_id": text.safe_doc_id(g("$.video.id"), kind), "query_keyword": F.coalesce(g("$.search_queries[0].query", "$.query_keyword", "$.query"), F.lit("youtube")), "title": g("$.video.title"), "text": F.trim(F.concat_ws("\n", *parts)), "created_at": g("$.video.publishedAt"), "collected_at": F.coalesce(dates.normalise_date(g("$.last_updated_at")), g("$.first_seen_at")), "url": F.concat(F.lit("https://www.youtube.com/watch?v="), g("$.video.id")), "source": g("$.video.channelTitle", "$.video.channelId")}
        cols |= {"city_context": F.when(~code.isin("AU", ""), code), "australia_connection": F.when(code == "AU", "youtube_search_region_AU").otherwise("youtube_housing_search"), "video_id": g("$.video.id"), "channel_title": g("$.video.channelTitle"), "like_count": g("$.video.likeCount")}
    else:
        url = g("$.article.url", "$.source_url", "$.url", "$.documentidentifier", "$.DocumentIdentifier", "$.document_identifier")
        title = g("$.article.title", "$.title", "$.headline", "$.name")
        source = g("$.article.domain", "$.source_name", "$.domain", "$.source", "$.source_domain", "$.sourceCommonName", "$.SourceCommonName")
        seen = g("$.article.seendate", "$.seendate", "$.date", "$.publish_date", "$.published_at", "$.created_at", "$.DATE")
        places = location_names(r)
        near = F.when(F.exists(places, lambda x: x.contains(COUNTRY)), "location_mentions_australia")
        cols = {"doc_id": text.safe_doc_id(F.coalesce(url, g("$.gkg_record_id", "$.record_id"), title), "gdelt_doc"), "platform": F.lit("gdelt_doc"), "query_keyword": _news_keyword(r), "title": title, "text": text.first_non_empty(g("$.article_text", "$.text", "$.content", "$.body", "$.description"), title, _news_fallback(r, source, url)), "created_at": dates.normalise_date(seen), "collected_at": g("$.harvested_at"), "url": url, "source": source}
        cols |= {"city_context": text.non_empty(F.array_join(F.slice(places, 1, 5), ", ")), "australia_connection": F.coalesce(near, g("$.article.sourcecountry", "$.sourcecountry", "$.source_country", "$.country"), F.lit(COUNTRY))}
    got = {c: F.lit(None) if c not in cols else cols[c] for c in POST}
    kept = {"platform": kind, "city_context": REGION, "topic": TOPIC, "australia_connection": UNKNOWN, "content_type": CONTENT.get(kind)}
    got = {c: F.coalesce(v.cast("string"), F.lit(kept.get(c)).cast("string")) for c, v in got.items()}
    if kind != "base":
        got["raw_metadata"] = F.to_json(F.col(r))
    got["like_count"] = text.to_int(got["like_count"])
    for c in ("created_at", "collected_at"):
        got[c] = dates.normalise_date(got[c])
    return df.filter(F.col("_kind") == kind).select(*[c for c in df.columns if c not in ("record", "_kind")], *[v.alias(k) for k, v in got.items()])


def normalise_posts(raw: DataFrame) -> DataFrame:
    """Canonical posts of (file, line, record); unknown shapes and posts without a text are dropped."""
    kinds = ("base", "bluesky", "mastodon", "youtube", "gdelt")
    df = raw.withColumn("_kind", platform_of())
    out = _branch(df, kinds[0])
    for k in kinds[1:]:
        out = out.unionByName(_branch(df, k))
    return out.filter((F.length(F.trim("text")) > 0) & (F.length("doc_id") > 0))


def live_news(rows: DataFrame, theme: str, place: Callable[[Column], Column], domain: str = ".au") -> DataFrame:
    """Posts of a news feed's live rows (source, stamp, url, themes, v2_themes, locations), and why each was taken.

    Taken are rows with a theme that matches the pattern, a place, or a domain. Both columns of themes count, and the first
    ten themes stand for the text; the feed has no titles, for which the address stands.
    """
    host, link = F.lower(F.coalesce("source", F.lit(""))), F.lower(F.coalesce("url", F.lit("")))
    own = host.endswith(domain) | link.contains(f"{domain}/") | link.contains(f"://{domain[1:]}.")
    themes = F.filter(F.transform(F.split(F.concat_ws(";", "themes", "v2_themes"), ";"), lambda t: F.trim(t)), lambda t: t != "")
    keep, why = filters.any_reason({"theme": F.exists(themes, lambda t: t.rlike(theme)), "location": place(F.coalesce("locations", F.lit(""))), "domain": own})
    few = F.array_join(F.slice(themes, 1, 10), ";")
    title = F.coalesce("url", F.lit(""))
    body = F.concat(F.lit("News: "), title, F.lit(". Themes: "), few)
    out = rows.filter(keep).select(
        text.safe_doc_id("url", "gdelt_doc").alias("doc_id"), F.lit("gdelt_doc").alias("platform"), "source", F.coalesce(F.lower(F.get(themes, F.lit(0))), F.lit("gdelt")).alias("query_keyword"),
        title.alias("title"), body.alias("text"), dates.stamp_or_text("stamp").alias("created_at"), "url", F.lit(REGION).alias("city_context"), F.lit(TOPIC).alias("topic"), F.lit(COUNTRY).alias("australia_connection"),
        F.lit(True).alias("housing_relevant"), F.lit(0).cast("long").alias("like_count"), why.alias("filter_reason"),
    )
    return mood.attach_live(out, "text")


def enrich(posts: DataFrame, subtopics: rules.Rules, regions: rules.Rules, lex: mood.Lexicon = mood.HOUSING) -> DataFrame:
    """Subtopic by keyword and then content, region by context, and sentiment: of titles for news, else of all text."""
    body = F.when(F.col("platform").startswith("gdelt"), F.coalesce(text.non_empty("title"), F.substring("text", 1, 500))).otherwise(F.concat_ws(" ", "title", "text"))
    out = posts.withColumns({"subtopic": rules.infer_subtopic("query_keyword", F.concat_ws(" ", "title", "text"), subtopics, "general"), "region": rules.first_match("city_context", regions, "Other")})
    return mood.attach(out, text.clean_social(body), lex)


def explode_thread(df: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """(key, part, parent, text): the head of a thread and each item below it that is not blank, as rows."""
    head = F.min(order).over(Window.partitionBy(key))
    return df.withColumn("_head", head).filter(F.length(F.trim(content)) > 0).select(key, F.col(order).alias("part"), F.when(F.col(order) > F.col("_head"), F.col("_head")).alias("parent"), F.col(content).alias("text"))


def fold_thread(df: DataFrame, key: str, order: str, content: str, most: int = 20) -> DataFrame:
    """(key, text): the head and the first `most` items after it, as one text.

    Only those rows are gathered, by their rank in the thread, so a long thread makes no long list.
    """
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= most + 1)
    items = F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col(content).alias("t"))))
    return ranked.groupBy(key).agg(F.array_join(F.transform(items, lambda x: x["t"]), "\n").alias("text"))


NOTE, HEADER = r"^\s*(note|source|footnote)", r"^(region|area|state|period|year|suburb)$"
PREFERRED = ["name", "label", "region", "area", "suburb", "state", "category"]
STATES = [("nsw", "NSW"), ("vic", "VIC"), ("qld", "QLD"), ("sa_", "SA"), ("tas", "TAS"), ("wa_", "WA"), ("aus", "AU")]


def official_rows(rows: DataFrame, most: int | None = None, unique: bool = False) -> DataFrame:
    """Searchable rows of (source_file, record_index, data: map of texts).

    Manifests, system files, skipped binaries and rows that are empty after cleaning are left out. most: rows of a file that
    are taken at most, in order. unique: of rows with one text only the first stays.
    """
    if most is not None:
        rows = dedup.first_per_group(rows, ["source_file"], ["record_index"], most)
    f = F.col("source_file")
    data = rows.filter(~F.lower(f).contains("manifest") & ~f.contains(".DS_Store") & ~F.coalesce(F.try_element_at("data", F.lit("_binary_skipped")) == "true", F.lit(False)))
    data = data.withColumn("data", rules.non_null_entries("data")).filter(F.size("data") > 0)
    out = data.select(
        text.safe_doc_id(F.concat_ws("_", "source_file", "record_index"), "official").alias("doc_id"), "source_file",
        rules.source_group("source_file").alias("source_group"), dates.infer_period("source_file").alias("period"),
        rules.contains_cascade("source_file", STATES, "AU").alias("region"), rules.row_type("data", NOTE, HEADER).alias("row_type"),
        rules.row_label("data", PREFERRED).alias("row_label"), rules.numeric_entries("data").alias("numeric_count"), rules.row_text("data").alias("text"), "data",
    )
    return dedup.first_wins(out, ["text"], ["source_file", "doc_id"]) if unique else out
