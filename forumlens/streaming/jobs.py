"""Structured Streaming jobs: windowed counts, idempotent upserts, and a stateful streak alert.

Late records are always taken, as the batch recomputation is the truth: windows are kept in complete mode. For a feed
that never ends, `watermark` bounds the state and closes windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from forumlens.sources.sinks import KeyedTable


def read_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files in the folder `path`, or of the one file; the checkpoint remembers which were done."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        # A stream reads folders: this one's folder, and in it only files of this name.
        return reader.option("pathGlobFilter", at.getName()).load(str(at.getParent()))
    return reader.load(path)


def run_to_end(stream: DataFrame, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> int:
    """Runs over all that is there in micro-batches, each handed to `each`, and stops; gives the number of rows that came too late."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)


def tumbling_counts(stream: DataFrame, ts: str, by: str, width: str = "1 day", watermark: str | None = None) -> DataFrame:
    """(start, by, count) by windows."""
    df = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark:
        df = df.withWatermark("_ts", watermark)
    return df.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), by, "count")


def keep_result(path: str) -> Callable[[DataFrame, int], None]:
    """A complete-mode result, replaced by each batch."""
    return lambda batch, _: batch.write.mode("overwrite").parquet(path)


def upsert_into(target: KeyedTable) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: target.merge(batch)


def enriched_into(target: KeyedTable, enrich: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch's rows, enriched and stamped with the time of their processing, go to `target`."""
    return lambda batch, _: target.merge(enrich(batch).withColumn("processed_at", F.current_timestamp()))


def logged(each: Callable[[DataFrame, int], None], log: str) -> Callable[[DataFrame, int], None]:
    """`each`, with a line in the table `log` when a batch starts, and when it is done or has failed, and why."""

    def note(batch: DataFrame, n: int, status: str, message: str | None = None) -> None:
        row = batch.sparkSession.createDataFrame([(n, status, message)], "batch long, status string, message string")
        row.withColumn("at", F.current_timestamp()).write.mode("append").parquet(log)

    def run(batch: DataFrame, n: int) -> None:
        note(batch, n, "started")
        try:
            each(batch, n)
        except Exception as e:
            note(batch, n, "failed", str(e)[:500])
            raise
        note(batch, n, "done")

    return run


def unfinished(log: DataFrame) -> DataFrame:
    """(batch, status, message) of batches that started and were never done: the job crashed in them, or they failed."""
    last = log.filter("status <> 'started'").groupBy("batch").agg(F.bool_or(F.col("status") == "done").alias("done"), F.max_by("message", "at").alias("message"))
    out = log.select("batch").distinct().join(last, "batch", "left").filter("done is null or not done")
    return out.select("batch", F.when(F.col("done").isNull(), "crashed").otherwise("failed").alias("status"), "message")


def count_bad_json(value: str, good: KeyedTable, schema: str, errors: str) -> Callable[[DataFrame, int], None]:
    """A batch's parsable records go to `good`, and a line with the number of others to `errors`."""

    def each(batch: DataFrame, n: int) -> None:
        parsed = batch.select(F.from_json(value, schema).alias("r"), F.try_parse_json(value).isNull().alias("bad"))
        good.merge(parsed.filter(~F.col("bad")).select("r.*"))
        parsed.groupBy().agg(F.lit(n).alias("batch"), F.count(F.when(F.col("bad"), 1)).alias("bad")).write.mode("append").parquet(errors)

    return each


class DayRuns(StatefulProcessor):
    """The days on which a key has rows, as state of runs of days in a row: a steady key is one run, however long.

    A key that has no rows for `alert` days after its last raises the alert by a timer, while nothing arrives.
    """

    def __init__(self, alert: int, keep: int | None):
        self.alert, self.keep = alert, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "first int", "last int")
        self.before = handle.getValueState("before", "longest int")

    def _row(self, key: tuple, runs: list[tuple[int, int]], silent: bool) -> pd.DataFrame:
        gaps = [b[0] - a[1] - 1 for a, b in zip(runs, runs[1:], strict=False)]
        before = self.before.get()
        longest = max([*gaps, before[0] if before else 0])
        return pd.DataFrame({"key": [key[0]], "runs": [[{"first": a, "last": b} for a, b in runs]], "days": [sum(b - a + 1 for a, b in runs)], "longest": [longest], "alert": [longest >= self.alert or silent], "silent": [silent]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        old = {k[0]: v[0] for k, v in self.runs.iterator()}
        days = {int(d) for b in rows for d in b["day"].unique()}
        runs: list[list[int]] = []
        for first, last in sorted([*old.items(), *((d, d) for d in days)]):
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        # Runs that end long before the last day are told by the longest gap after any of them.
        while self.keep is not None and len(runs) > 1 and runs[0][1] < runs[-1][1] - self.keep:
            before = self.before.get()
            self.before.update((max(before[0] if before else 0, runs[1][0] - runs[0][1] - 1),))
            runs.pop(0)
        now = {a: b for a, b in runs}
        for first in old.keys() - now.keys():
            self.runs.removeKey((first,))
        for first, last in now.items():
            if old.get(first) != last:
                self.runs.updateValue((first,), (last,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer((runs[-1][1] + 1 + self.alert) * 86_400_000)
        yield self._row(key, runs, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, sorted((k[0], v[0]) for k, v in self.runs.iterator()), True)

    def close(self) -> None:
        pass


RUNS = "key long, runs array<struct<first: int, last: int>>, days int, longest int, alert boolean, silent boolean"


def gap_alerts(stream: DataFrame, key: str, ts: str, alert: int, late: str = "30 days", keep: int | None = None) -> DataFrame:
    """(key, runs, days, longest, alert, silent) of each key whose days changed, or that has been silent for `alert` days.

    runs: the runs of days with rows; longest: the longest run of days without any between them. late: how much later than
    the latest rows may come, and how long a silence is waited for. keep: days before a key's last of which runs are kept,
    all by default. Needs the RocksDB state store, which with_state_store() turns on.
    """
    days = stream.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    days = days.withColumn("day", F.date_diff(F.col("at").cast("date"), F.lit("1970-01-01").cast("date")))
    return days.groupBy("key").transformWithStateInPandas(DayRuns(alert, keep), RUNS, "Update", "EventTime")


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, on disk and not on the heap."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def streaks_of(runs: DataFrame, alert: int) -> DataFrame:
    """(key, start, days, alert): the runs of days without rows, of gap_alerts()'s runs."""
    pairs = F.explode(F.transform(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), lambda r, i: F.struct((F.get("runs", i)["last"] + 1).alias("start"), (r["first"] - F.get("runs", i)["last"] - 1).alias("days"))))
    each = runs.select("key", pairs.alias("gap"))
    return each.select("key", F.date_add(F.lit("1970-01-01").cast("date"), F.col("gap.start")).alias("start"), F.col("gap.days").alias("days"), (F.col("gap.days") >= alert).alias("alert"))


def first_within(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Each key's first row; a key is remembered for `late` after its time, by which repeats must have come."""
    return stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")


def session_counts(df: DataFrame, ts: str, by: str, gap: str, watermark: str | None = None) -> DataFrame:
    """(by, start, end, count) of sessions, which end when a key has no row for `gap`; of a table or a stream."""
    df = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark:
        df = df.withWatermark("_ts", watermark)
    out = df.groupBy(F.session_window("_ts", gap).alias("w"), by).agg(F.count("*").alias("count"), F.max("_ts").alias("last"))
    return out.select(by, F.col("w.start").alias("start"), F.col("last").alias("end"), "count")


def messages(value: str) -> Column:
    """The records of a message as an array of variants: an object is one, a list is its elements, and an element that is
    a text is parsed itself. Null for a message, or an element of one, that is no JSON, or neither object nor text."""
    parsed = F.try_parse_json(F.col(value))
    one = F.schema_of_variant(parsed).startswith("OBJECT")
    many = F.when(one, F.array(parsed)).otherwise(F.try_variant_get(parsed, "$", "array<variant>"))
    record = lambda x: F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_parse_json(F.try_variant_get(x, "$", "string"))), x)
    return F.transform(many, lambda x: F.when(F.schema_of_variant(record(x)).startswith("OBJECT"), record(x)))


def records_into(value: str, schema: str, good: KeyedTable, errors: str) -> Callable[[DataFrame, int], None]:
    """The records of a batch's messages go to `good`; `errors` gets a line for each message with faults: how many it has."""

    def each(batch: DataFrame, n: int) -> None:
        whole = batch.select(F.col(value).alias("message"), messages(value).alias("records"))
        rows = whole.select(F.explode("records").alias("r")).filter("r is not null").select(F.from_json(F.to_json("r"), schema).alias("r"))
        good.merge(rows.select("r.*"))
        bad = F.when(F.col("records").isNull(), 1).otherwise(F.size(F.filter("records", lambda r: r.isNull())))
        whole.select(F.lit(n).alias("batch"), "message", bad.alias("bad")).filter("bad > 0").write.mode("append").parquet(errors)

    return each


class ProgressLog(StreamingQueryListener):
    """Writes what Spark tells of its streams to the table `log`: (query, run, event, batch, rows, message, at)."""

    SCHEMA = "query string, run string, event string, batch long, rows long, message string"

    def __init__(self, spark: SparkSession, log: str):
        self.spark, self.log = spark, log

    def _note(self, *row) -> None:
        # A folder of its own for each event, as streams report at the same time and two writers of one folder disturb each other.
        self.spark.createDataFrame([row], self.SCHEMA).withColumn("at", F.current_timestamp()).coalesce(1).write.parquet(f"{self.log}/{uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, at timestamp").option("recursiveFileLookup", True).parquet(self.log)

    def onQueryStarted(self, event) -> None:
        self._note(str(event.id), str(event.runId), "started", None, None, event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self._note(str(p.id), str(p.runId), "progress", p.batchId, p.numInputRows, f"{dropped} late" if dropped else None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._note(str(event.id), str(event.runId), "crashed" if event.exception else "ended", None, None, (event.exception or "")[:8000] or None)


def run_every(stream: DataFrame, seconds: int, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Starts a stream with a micro-batch every so many seconds, each handed to `each`, until it is stopped."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(processingTime=f"{seconds} seconds").start()
