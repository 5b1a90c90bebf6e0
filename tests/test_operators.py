"""Operators that the oracles don't reach, on small tables."""

import datetime as dt
import json
import math
import random
import statistics
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.operators import aggs, dedup, evaluation, filters, inverted, normalise, retrieval, sentiment
from forumlens.plans.panels import SearchRequest, Tools
from forumlens.sources import readers, sinks
from forumlens.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_terms_ties_nulls_and_empty_keys(spark):
    df = spark.createDataFrame([("b",), ("a",), ("",), (None,), ("b",), ("a",)], "k string")
    assert [tuple(r) for r in aggs.terms(df, "k").collect()] == [("a", 2), ("b", 2), ("", 1)]
    assert [tuple(r) for r in aggs.terms(df, "k", 1, by_key=True).collect()] == [("", 1)]
    assert ("?", 1) in rows(aggs.terms(df, "k", missing="?"))
    assert rows(aggs.terms(df, "k", exclude="a|b")) == [("", 1)]


def test_histogram_fills_gaps_and_checks_intervals(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "x"), (dt.datetime(2024, 1, 4), "x"), (dt.datetime(2024, 1, 2), "y"), (None, "x")], "t timestamp, k string")
    got = rows(aggs.date_histogram(df, "t", "day", ["k"], densify=True).select("k", "date", "count"))
    assert got == [("x", dt.date(2024, 1, d), int(d in (1, 4))) for d in (1, 2, 3, 4)] + [("y", dt.date(2024, 1, 2), 1)]
    with pytest.raises(ValueError):
        aggs.bucket("t", "fortnight")


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 2, "B"), (3, 1, "c"), (None, 9, "z")], "k int, t int, v string")
    once = dedup.upsert(old, new, "k", "t")
    assert rows(once) == rows(dedup.upsert(once, new, "k", "t")) == [(1, 1, "a"), (2, 2, "B"), (3, 1, "c")]


def test_first_best_and_last(spark):
    df = spark.createDataFrame([("x", 2, 5), ("x", 1, 5), ("y", 3, None), (None, 0, 1)], "k string, n int, s int")
    assert rows(dedup.first_wins(df, ["k"], ["n"])) == [("x", 1, 5), ("y", 3, None)]
    assert rows(dedup.best_wins(df, ["k"], "s", "n").select("k", "n")) == [("x", 1), ("y", 3)]
    assert rows(dedup.last_wins(df, ["k"], "n", "s").select("k", "n")) == [("x", 2), ("y", 3)]


def test_filters(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 23), "NSW", None), (dt.datetime(2024, 2, 1), "AU", 3)], "t timestamp, r string, p int")
    assert df.filter(filters.date_range("t", dt.date(2024, 1, 1), dt.date(2024, 1, 31))).count() == 1
    assert df.filter(filters.region_or_national("r", "NSW")).count() == 2
    assert df.filter(filters.region_or_national("r", "VIC")).count() == 1
    assert df.filter(filters.null_tolerant_range("p", F.lit(4))).count() == 1
    assert [filters.clamp_arg(x, 1, 20, 5) for x in ("7", None, "x", 99, -3)] == [7, 5, 5, 20, 1]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [("d1", "rents rise in sydney", "x"), ("d2", "rents fall", "x"), ("d3", "weather is fine", "x"), ("o1", "rents table", "y")]
    return spark.createDataFrame(docs, "id string, text string, corpus string")


def test_search_gate_and_isolation(spark, corpus):
    hit = lambda q, c="x", **k: [r.id for r in inverted.search(corpus, q, "id", "text", where=F.col("corpus") == c, **k).collect()]
    assert hit("rents sydney") == ["d1", "d2"]
    assert hit("quantum chromodynamics") == []  # several important terms and none there
    assert len(hit("quantum")) == 3  # one important term: the gate opens
    assert hit("rents", "y") == ["o1"]
    assert [r["rank"] for r in inverted.search(corpus, "rents", "id", "text", k=2).collect()] == [1, 2]


def test_tools_check_their_arguments(spark, corpus):
    docs = corpus.withColumns({"region": F.when(F.col("id") == "d1", "NSW").when(F.col("id") == "d3", "VIC").otherwise("AU"), "mood": F.lit(0.5)})
    tools = Tools(docs, {"id": "id", "text": "text", "corpus": "corpus", "region": "region", "sentiment": "mood"}, "x", "y")
    found = lambda name, **a: sorted(r.id for r in tools.call(name, **a).evidence.collect())
    assert found("search_discussion", query="rents") == ["d1", "d2"] and found("search_official", query="rents") == ["o1"]
    assert found("search_discussion", query="rents", region="VIC") == ["d2"]  # national documents stand for each region
    assert rows(tools.call("aggregate_topic", topic="rents").data)[-1] == ("total", None, 2)
    compared = {r.region: (r.discussion_hits, r.official_hits) for r in tools.call("compare_regions", query="rents", regions=["NSW", "VIC", "QLD"]).data.collect()}
    assert compared == {"NSW": (2, 1), "VIC": (1, 1), "QLD": (1, 1)}
    assert [(r.id, r.mean_sentiment, r["count"]) for r in tools.call("sentiment_trend", topic="fine").data.collect()] == [("d3", 0.5, 1)]
    assert tools.call("coverage").data.first().document_count == 4 and tools.call("coverage", corpus="y").data.first().document_count == 1
    bad = [lambda: tools.call("drop"), lambda: SearchRequest("x"), lambda: SearchRequest("fine", 21), lambda: tools.call("compare_regions", query="rents", regions=["NSW", "NSW"])]
    bad.append(lambda: SearchRequest("fine", start=date(2024, 2, 1), end=date(2024, 1, 1)))
    for f in bad:
        with pytest.raises(ValueError):
            f()


def test_sentiment_thresholds(spark):
    got = [r.l for r in spark.createDataFrame([(0.04,), (0.0399,), (-0.04,), (-0.0399,)], "s double").select(sentiment.label("s").alias("l")).collect()]
    assert got == ["positive", "neutral", "negative", "neutral"]
    lex = sentiment.Lexicon({"not good": -0.5}, {}, {"bad": -0.4}, {"bad": 0.9, "good": 0.3}, ("rent",))
    df = spark.createDataFrame([("bad",), ("",), (None,), ("not good rent",), ("https://x.y",)], "t string")
    got = [r.d for r in df.select(F.round(sentiment.domain_score("t", lex), 6).alias("d")).collect()]
    assert got[:3] == [-0.4, 0.0, 0.0]
    assert abs(got[3] - (-0.5 + 0.3 - 0.06) / 1.386294) < 1e-5


RAW = [
    {"platform": "bluesky", "search_query": "rent", "harvested_at": "2024-03-02", "post": {"uri": "at://x/1", "author_handle": "jo", "created_at": "2024-03-01T00:00:00Z", "text": "Rent is up"}},
    {"platform": "mastodon", "instance": "m.au", "search_hashtag": "rent", "status": {"id": "9", "url": "https://m/9", "created_at": "20240301", "content": "<p>Cannot afford &amp; worse</p>"}},
    {"platform": "gdelt_doc", "search_query": "housing", "article": {"url": "https://n/1", "title": "Housing relief", "seendate": "20240301T120000Z", "domain": "n.com"}},
    {"themes": "ECON_HOUSING", "title": "By keys", "url": "https://n/2", "date": "20240301120000"},
    {"video": {"id": "v1", "title": "Tour", "description": "", "publishedAt": "2024-03-01T00:00:00Z", "channelTitle": "C", "tags": ["a", "b"]}, "comments": [{"text": "one"}, {"textOriginal": " "}, {"textDisplay": "two"}]},
    {"doc_id": "z", "platform": "bluesky", "text": "Full", "created_at": "2024-01-01"},
    {"unknown": 1},
    {"platform": "bluesky", "post": {"uri": "at://x/2", "text": ""}},
]


def test_raw_posts_to_canonical(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in RAW) + "\n[1]\n{bad\n")
    raw = readers.read_objects(spark, str(tmp_path))
    assert raw.count() == len(RAW)
    got = {r.doc_id: r for r in normalise.normalise_posts(raw).collect()}
    assert set(got) == {"bluesky_at___x_1", "mastodon_9", "gdelt_doc_https___n_1", "gdelt_doc_https___n_2", "youtube_v1", "post_z"}
    assert got["mastodon_9"].text == "Cannot afford & worse" and got["mastodon_9"].created_at == "2024-03-01T00:00:00Z"
    assert got["youtube_v1"].text == "Tour\nTags: a b\nComments: one two"
    assert got["gdelt_doc_https___n_1"].text == "Housing relief"
    out = normalise.enrich(normalise.normalise_posts(raw), [("cost", "rent|afford")], [("AU", "australia")])
    tags = {r.doc_id: (r.subtopic, r.region, r.sentiment_label) for r in out.collect()}
    assert tags["mastodon_9"] == ("cost", "AU", "negative")
    assert tags["bluesky_at___x_1"] == ("cost", "AU", "neutral") and tags["gdelt_doc_https___n_1"][2] == "positive"
    assert (got["bluesky_at___x_1"].topic, got["bluesky_at___x_1"].australia_connection, got["bluesky_at___x_1"].content_type) == ("housing", "unknown", "bluesky_post")
    assert json.loads(got["gdelt_doc_https___n_2"].raw_metadata)["title"] == "By keys" and got["gdelt_doc_https___n_2"].query_keyword == "gdelt"
    assert got["youtube_v1"].query_keyword == "youtube" and got["youtube_v1"].city_context == "australia"
    (counts,) = readers.count_bad_lines(spark, str(tmp_path)).collect()
    assert (counts.read, counts.usable, counts.skipped) == (len(RAW) + 2, len(RAW) + 1, 1)


def test_lines_are_numbered_however_files_are_split(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k}\n" if k % 5 else "\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 6000 and all(r.value in ("", f"{r.value[:1]}{r.line - 1}") for r in got)
    assert {(r.file[-5], r.line) for r in got} == {(n, k + 1) for n in "ab" for k in range(3000)}


def test_lines_are_counted_on_through_the_parts_of_a_text(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"part-{n}.txt").write_text("".join(f"{n * 1000 + k + 1}\n" for k in range(1000 if n != 2 else 0)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        got = readers.numbered_lines(spark, str(tmp_path), through=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.line, int(r.value)) for r in got} == {(k, k if k <= 2000 else k + 1000) for k in range(1, 3001)}


def test_official_files_and_caps(spark, tmp_path):
    for name in ("official_sources_json_v2/a.jsonl", "official_sources_json_v3/z.jsonl", "official_sources_json_v3/normalised_1.jsonl"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("{}")
    names = lambda df: [r.file.rsplit("/", 1)[1] for r in df.collect()]
    assert names(readers.official_files(spark, str(tmp_path))) == ["normalised_1.jsonl", "z.jsonl", "a.jsonl"]
    with pytest.warns(UserWarning, match="no folder"):
        assert names(readers.list_files(spark, [str(tmp_path / "none"), str(tmp_path)], "*.jsonl", without=("^normalised_",))) == ["a.jsonl", "z.jsonl"]
    with pytest.raises(FileNotFoundError):
        readers.official_files(spark, str(tmp_path / "none"))
    rows_ = spark.createDataFrame([("x/a.csv", k, {"v": "same"}) for k in range(5)], "source_file string, record_index int, data map<string,string>")
    assert [normalise.official_rows(rows_, most=m, unique=u).count() for m, u in ((None, False), (2, False), (None, True))] == [5, 2, 1]


def test_modes_of_json_lines(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{oops\n')
    ok = readers.read_jsonl(spark, str(tmp_path), "a int", "PERMISSIVE").cache()
    assert sorted((r.a or 0, r._corrupt_record or "") for r in ok.collect()) == [(0, "{oops"), (1, "")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|alformed"):
        readers.read_jsonl(spark, str(tmp_path), "a int").collect()


def test_zipped_tsv_and_file_lists(spark, tmp_path):
    for stamp in ("20240301000000", "20240302234500", "20240303000000"):
        with zipfile.ZipFile(tmp_path / f"{stamp}.gkg.csv.zip", "w") as z:
            z.writestr("x.csv", "\t".join("abcdefghijk") + "\nshort\trow\n" + "\t".join(["1"] * 8) + "\n")
    assert readers.read_zipped_tsv(spark, str(tmp_path)).count() == 6
    row = readers.read_zipped_tsv(spark, str(tmp_path)).filter("stamp = 'b'").first()
    assert tuple(row)[1:] == ("b", "d", "e", "h", "i", "j") and row.v2_themes == "i" and row.locations == "j"
    files = readers.list_files(spark, str(tmp_path), "*.zip", "20240301", "20240302")
    assert files.count() == 2 and readers.latest_file(files).first().stamp == "20240302234500"


def test_official_rows(spark):
    data = [("rents/nsw_2024-03.csv", 0, {"name": "North", "rent": "1,200", "x": "nan"}), ("a/manifest_1.json", 0, {"a": "b"}), ("c/.DS_Store", 0, {"a": "b"}), ("d/e.csv", 1, {"x": "None"}), ("d/e.csv", 2, {"_binary_skipped": "true"})]
    out = normalise.official_rows(spark.createDataFrame(data, "source_file string, record_index int, data map<string,string>")).collect()
    assert len(out) == 1
    assert (out[0].source_group, out[0].period, out[0].region, out[0].row_type, out[0].numeric_count, out[0].row_label) == ("rents", "2024-03", "NSW", "data", 1, "North")


def test_keyed_table_and_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.LongType())])
    table = sinks.KeyedTable(spark, f"{tmp_path}/keyed", schema, "k", "t")
    assert table.read().count() == 0
    for part in ([(1, 1), (2, 1), (1, 2)], [(2, 5), (2, 3), (None, 1)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: jobs.read_files(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    jobs.run_to_end(stream(), "append", f"{tmp_path}/c1", jobs.upsert_into(table))
    jobs.run_to_end(stream(), "append", f"{tmp_path}/c1", jobs.upsert_into(table))  # nothing is new
    assert rows(table.read()) == [(1, 2), (2, 5)]
    table.merge(spark.createDataFrame([(2, 5)], schema))
    assert rows(table.read()) == [(1, 2), (2, 5)]


def test_bad_messages_are_counted(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.txt").write_text('{"k": 1, "t": 1}\nnot json\n')
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.LongType())])
    table = sinks.KeyedTable(spark, f"{tmp_path}/keyed", schema, "k", "t")
    each = jobs.count_bad_json("value", table, "k long, t long", f"{tmp_path}/errors")
    jobs.run_to_end(jobs.read_files(spark, f"{tmp_path}/q", "value string", "text"), "append", f"{tmp_path}/c", each)
    assert rows(table.read()) == [(1, 1)]
    assert [r.bad for r in spark.read.parquet(f"{tmp_path}/errors").collect()] == [1]


def test_failed_batches_are_logged(spark, tmp_path):
    df = spark.range(3)

    def broken(batch, n):
        raise RuntimeError("no luck")

    log = f"{tmp_path}/log"
    jobs.logged(lambda b, n: None, log)(df, 0)
    with pytest.raises(RuntimeError):
        jobs.logged(broken, log)(df, 1)
    assert rows(jobs.unfinished(spark.read.parquet(log))) == [(1, "failed", "no luck")]


def test_jsonl_sink_has_no_nan(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, x double"), f"{tmp_path}/out")
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["k"]) == [{"k": 1}, {"k": 2, "x": 0.5}]
    assert sinks.write_jsonl(spark.range(7), f"{tmp_path}/more", ["id"]) == 7


def test_stamps_of_folders_above_are_no_files_stamps(spark, tmp_path):
    """A cluster names its applications by the time, and the shared folder's tables lie below that name."""
    root = tmp_path / "app-20261128094439-0000" / "days"
    for stamp in ("20240104000000", "20240105000000"):
        (root / f"stamp={stamp}").mkdir(parents=True)
        (root / f"stamp={stamp}" / "part.txt").write_text("x")
    files = readers.list_files(spark, [str(root), str(tmp_path)], "*.txt")
    assert [r.stamp for r in files.collect()] == ["20240104000000", "20240105000000"] and readers.latest_file(files).first().stamp == "20240105000000"
    assert readers.list_files(spark, f"file://{root}/", "*.txt", "20240105", "20240120").count() == 1


def test_percentiles_are_exact_and_no_task_holds_a_group(spark):
    rnd = random.Random(5)
    rows_ = [(g, rnd.choice([rnd.randint(0, 9) / 2, rnd.random() * 1e5])) for g, n in (("a", 1), ("b", 2), ("c", 20), ("d", 1001), (None, 300)) for _ in range(n)] + [("e", None), ("c", None)]
    df = spark.createDataFrame(rows_, "variant string, latency_ms double").repartition(5)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = evaluation.percentiles(df, "variant", "latency_ms")
        got_rows = {r.variant: (round(r.p50, 9), r.p95) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    want = {}
    for g in ("a", "b", "c", "d", None):
        v = sorted(x for k, x in rows_ if k == g and x is not None)
        want[g] = (round(statistics.median(v), 9), v[max(0, math.ceil(len(v) * 0.95) - 1)])
    assert got_rows == want
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
