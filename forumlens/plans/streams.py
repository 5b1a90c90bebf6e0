"""Registered streaming queries, which must equal their batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.operators import normalise
from forumlens.plans.registry import query
from forumlens.session import fresh_dir, table
from forumlens.sources.sinks import KeyedTable
from forumlens.streaming import jobs


def _events(spark, sf):
    return jobs.read_files(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema)


@query("stream_tumbling_counts", "SELECT ts::DATE AS date, event_type, count(*) AS count FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, sf):
    out = fresh_dir(spark, "counts")
    jobs.run_to_end(jobs.tumbling_counts(_events(spark, sf), "ts", "event_type"), "complete", f"{out}/checkpoint", jobs.keep_result(f"{out}/table"))
    return spark.read.parquet(f"{out}/table").select(F.col("start").cast("date").alias("date"), "event_type", "count")


@query("stream_dedup_upsert", "SELECT user_id, max(ts) AS ts FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def stream_dedup_upsert(spark, sf):
    out = fresh_dir(spark, "latest")
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])
    target = KeyedTable(spark, f"{out}/table", schema, "user_id", "ts")
    jobs.run_to_end(_events(spark, sf).select("user_id", "ts"), "append", f"{out}/checkpoint", jobs.upsert_into(target))
    return target.read()


@query(
    "stream_streak",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), g AS (SELECT user_id, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) - 1 AS gap FROM d)
SELECT user_id, coalesce(max(gap), 0)::INT AS longest, coalesce(max(gap), 0) >= 3 AS alert FROM g GROUP BY 1""",
)
def stream_streak(spark, sf):
    return _runs(spark, sf, 3).select(F.col("key").alias("user_id"), "longest", (F.col("longest") >= 3).alias("alert"))


def _runs(spark, sf, alert):
    """The last runs of each user's days that the stream told."""
    out = fresh_dir(spark, "streaks")
    target = KeyedTable(spark, f"{out}/table", T.StructType.fromDDL(jobs.RUNS), "key", "days")
    with jobs.with_state_store(spark):
        jobs.run_to_end(jobs.gap_alerts(_events(spark, sf), "user_id", "ts", alert), "update", f"{out}/checkpoint", jobs.upsert_into(target))
    return target.read()


@query(
    "stream_zero_streaks",
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), g AS (SELECT user_id, d, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) - 1 AS days FROM d)
SELECT user_id, d - days::INT AS start, days::INT AS days, days >= 2 AS alert FROM g WHERE days > 0""",
)
def stream_zero_streaks(spark, sf):
    """Every run of days without rows, from the state's runs of days with rows."""
    return jobs.streaks_of(_runs(spark, sf, 2), 2).withColumnRenamed("key", "user_id")


@query("stream_first_within", "SELECT event_id, user_id, event_type, value FROM events")
def stream_first_within(spark, sf):
    """Events that are delivered twice, in files of their own, come out once."""
    out, events = fresh_dir(spark, "within"), table(spark, sf, "events")
    for _ in range(2):
        events.write.mode("append").parquet(f"{out}/in")
    stream = jobs.first_within(jobs.read_files(spark, f"{out}/in", events.schema), ["event_id"], "ts", "100000 days")
    jobs.run_to_end(stream, "append", f"{out}/checkpoint", lambda batch, n: batch.write.mode("append").parquet(f"{out}/table"))
    return spark.read.schema(events.schema).parquet(f"{out}/table").select("event_id", "user_id", "event_type", "value")


_SESSIONS = """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true)::INT AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS count FROM s GROUP BY user_id, n"""


def _plain(sessions):
    return sessions.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "count")


@query("session_windows", _SESSIONS)
def session_windows(spark, sf):
    return _plain(jobs.session_counts(table(spark, sf, "events"), "ts", "user_id", "6 hours"))


@query("stream_session_windows", _SESSIONS)
def stream_session_windows(spark, sf):
    out = fresh_dir(spark, "sessions")
    jobs.run_to_end(jobs.session_counts(_events(spark, sf), "ts", "user_id", "6 hours"), "complete", f"{out}/checkpoint", jobs.keep_result(f"{out}/table"))
    return _plain(spark.read.parquet(f"{out}/table"))


@query(
    "stream_queue_messages",
    "SELECT c_custkey AS k, c_mktsegment AS segment, 0 AS unparsed FROM customer",
)
def stream_queue_messages(spark, sf):
    """Customers as messages of three shapes: an object, a list of objects, a list of texts that are objects."""
    out = fresh_dir(spark, "queue")
    one = table(spark, sf, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"), F.lit(1).alias("t"))).alias("j"))
    shape = F.col("c_custkey") % 3
    lists = one.filter(shape > 0).groupBy(shape.alias("shape"), (F.col("c_custkey") / 12).cast("int")).agg(F.collect_list("j").alias("js"))  # at most twelve
    text = F.when(F.col("shape") == 1, F.concat(F.lit("["), F.array_join("js", ","), F.lit("]"))).otherwise(F.to_json("js"))
    one.filter(shape == 0).select("j").union(lists.select(text)).write.text(f"{out}/in")
    target = KeyedTable(spark, f"{out}/table", T.StructType.fromDDL("k long, segment string, t long"), "k", "t")
    each = jobs.records_into("value", "k long, segment string, t long", target, f"{out}/errors")
    jobs.run_to_end(jobs.read_files(spark, f"{out}/in", "value string", "text"), "append", f"{out}/checkpoint", each)
    errors = spark.read.schema("batch int, message string, bad int").parquet(f"{out}/errors").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("int").alias("unparsed"))
    return target.read().select("k", "segment").crossJoin(errors)  # one row


@query(
    "stream_enriched",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' ELSE 'general' END AS subtopic, CASE WHEN source = 'src1' THEN 'one' ELSE 'Other' END AS region, true AS processed, 0 AS unfinished FROM documents""",
)
def stream_enriched(spark, sf):
    """Documents enriched in the stream, with the time of their processing, and a log of batches of which none is open."""
    out, docs = fresh_dir(spark, "enriched"), table(spark, sf, "documents")
    names = {"doc_id": "long", "subtopic": "string", "region": "string", "processed_at": "timestamp"}
    target = KeyedTable(spark, f"{out}/table", T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in names.items())), "doc_id", "processed_at")

    def enrich(batch):
        posts = batch.select("doc_id", F.lit("bluesky").alias("platform"), F.lit("").alias("query_keyword"), F.lit(None).cast("string").alias("title"), "text", F.col("source").alias("city_context"))
        return normalise.enrich(posts, [("legal", "license")], [("one", "^src1$")])

    stream = jobs.read_files(spark, f"{sf}/documents.parquet", docs.schema)
    jobs.run_to_end(stream, "append", f"{out}/checkpoint", jobs.logged(jobs.enriched_into(target, enrich), f"{out}/log"))
    open_ = jobs.unfinished(spark.read.parquet(f"{out}/log")).agg(F.count("*").cast("int").alias("unfinished"))
    return target.read().select("doc_id", "subtopic", "region", F.col("processed_at").isNotNull().alias("processed")).crossJoin(open_)  # one row
