import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.sources.sinks import ERRORS, KeyedTable
from forumlens.streaming import jobs

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("t", T.LongType()), T.StructField("v", T.StringType())])


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_a_merge_rewrites_the_buckets_of_its_rows_only(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "t", buckets=8)
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([(f"k{n}", 1, "old") for n in range(200)], SCHEMA))
    before, folders = files(tmp_path / "t"), table.manifest()["folders"]
    assert len(folders) == 8
    made = table.merge(spark.createDataFrame([("k7", 2, "new"), ("k7", 1, "older")], SCHEMA))
    new = set(files(tmp_path / "t")) - set(before)
    assert len({f.split("bucket=")[1].split("/")[0] for f in new}) == 1 and all("/v2/" in f for f in new)
    assert sum(made["folders"][b] != v for b, v in folders.items()) == 1
    assert table.read().count() == 200 and table.read().filter("k = 'k7'").collect()[0].v == "new"


def test_rows_without_a_key_are_counted_and_the_first_kept(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "t")
    made = table.merge(spark.createDataFrame([(None, n, "x") for n in range(ERRORS + 4)] + [("a", 1, "y")], SCHEMA))
    assert (made["rows"], made["keyless"], len(made["errors"])) == (1, ERRORS + 4, ERRORS) and made == table.manifest()
    assert all(json.loads(e)["v"] == "x" for e in made["errors"])
    made = table.merge(spark.createDataFrame([(None, 1, "z")], SCHEMA))
    assert made["keyless"] == 1 and [tuple(r) for r in table.read().collect()] == [("a", 1, "y")]


def test_merges_equal_a_dictionary_and_old_versions_go(spark, tmp_path):
    rnd, want = random.Random(3), {}
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "t", buckets=4)
    for n in range(6):
        rows = [(f"k{rnd.randrange(30)}", rnd.randrange(50), f"{n}-{k}") for k in range(rnd.choice([1, 25]))]
        rows = list({(k, t): (k, t, v) for k, t, v in rows}.values())
        for k, t, v in rows:
            if k not in want or t >= want[k][0]:
                want[k] = (t, v)
        for _ in range(2):  # a delivery may repeat
            table.merge(spark.createDataFrame(rows, SCHEMA))
        assert {r.k: (r.t, r.v) for r in table.read().collect()} == want
    assert len(table.versions()) == 2
    named = {(v, b) for n in table.versions() for b, v in table.manifest(n)["folders"].items()}
    there = {(int(f.split("/v")[1].split("/")[0]), f.split("bucket=")[1].split("/")[0]) for f in files(tmp_path / "t")}
    assert there == named


def days(spark, path, *batches):
    for n, rows in enumerate(batches):
        at = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=3)) for k, d in rows]
        spark.createDataFrame(at, "k long, ts timestamp").coalesce(1).write.parquet(f"{path}/in/n{n}")
        time.sleep(1.1)  # files are taken in the order of their times


def streaks(spark, tmp_path, late="5 days", **how):
    schema = T.StructType.fromDDL("k long, ts timestamp")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = []
    with jobs.with_state_store(spark):
        jobs.run_to_end(jobs.gap_alerts(stream, "k", "ts", 3, late, **how), "update", f"{tmp_path}/c", lambda b, n: out.extend(b.collect()))
    return out


def test_a_steady_key_is_one_run_and_a_silent_one_raises_the_alert(spark, tmp_path):
    days(spark, tmp_path, [(1, d) for d in range(0, 12, 2)] + [(2, 0), (2, 1)], [(1, d) for d in range(1, 12, 2)], [(1, 12), (1, 30)])
    out = streaks(spark, tmp_path)
    steady = [r for r in out if r.key == 1 and not r.silent]
    assert [len(r.runs) for r in steady] == [6, 1, 2] and [r.days for r in steady] == [6, 12, 14] and [r.longest for r in steady] == [1, 0, 17]
    assert [(r.key, r.alert) for r in out if r.silent and r.key == 2] == [(2, True)]  # nothing of key 2 arrived
    assert not [r for r in out if r.silent and r.key == 1 and r.days == 14]


def test_old_runs_go_and_their_longest_gap_stays(spark, tmp_path):
    days(spark, tmp_path, [(1, 0), (1, 9), (1, 11)], [(1, 40)], [(1, 41)])
    last = [r for r in streaks(spark, tmp_path, "100 days", keep=10) if not r.silent][-1]
    assert [tuple(r) for r in last.runs] == [tuple(last.runs[0])] and last.longest == 28 and last.alert


def test_repeats_and_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    for n, rows in enumerate([[(1, base), (2, base)], [(1, base), (3, base + dt.timedelta(days=9))], [(3, base + dt.timedelta(days=9))], [(4, base), (5, base + dt.timedelta(days=9))]]):
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/n{n}")
        time.sleep(1.1)
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = []
    late = jobs.run_to_end(jobs.first_within(stream, ["id"], "ts", "1 day"), "append", f"{tmp_path}/c", lambda b, n: got.extend(r.id for r in b.collect()))
    assert sorted(got) == [1, 2, 3, 5] and late == 1  # id 4 came nine days late


def test_sessions_of_ties_and_gaps(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    df = spark.createDataFrame([("a", at(m)) for m in (0, 0, 5, 40, 41)] + [("b", at(3)), ("b", None)], "k string, ts timestamp")
    got = sorted((r.k, r.start, r.end, r["count"]) for r in jobs.session_counts(df, "ts", "k", "10 minutes").collect())
    assert got == [("a", at(0), at(5), 3), ("a", at(40), at(41), 2), ("b", at(3), at(3), 1)]


def test_messages_of_every_shape(spark):
    texts = ['{"k": 1}', '[{"k": 1}, {"k": 2}]', '["{\\"k\\": 1}", "{\\"k\\": 2}"]', "[]", "no json", "7", '[{"k": 3}, 4, "x", "[1]"]', None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, value string").select("n", F.transform(jobs.messages("value"), lambda r: F.to_json(r)).alias("r"))
    assert [r.r for r in rows.orderBy("n").collect()] == [['{"k":1}'], ['{"k":1}', '{"k":2}'], ['{"k":1}', '{"k":2}'], [], None, None, ['{"k":3}', None, None, None], None]


def test_faulty_messages_are_counted(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.txt").write_text('{"k": "a", "t": 1}\n[{"k": "b", "t": 1}, 5]\nnot json\n')
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", "t")
    each = jobs.records_into("value", SCHEMA.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), table, f"{tmp_path}/errors")
    jobs.run_to_end(jobs.read_files(spark, str(tmp_path / "q"), "value string", "text"), "append", f"{tmp_path}/c", each)
    assert sorted(r.k for r in table.read().collect()) == ["a", "b"]
    assert sorted((r.message, r.bad) for r in spark.read.parquet(f"{tmp_path}/errors").collect()) == [('[{"k": "b", "t": 1}, 5]', 1), ("not json", 1)]


def test_the_listener_tells_of_a_batch_that_broke(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_files(spark, f"{tmp_path}/in", "id long")
    listener = jobs.ProgressLog(spark, f"{tmp_path}/log")
    spark.streams.addListener(listener)

    def broken(batch, n):
        raise RuntimeError("no luck")

    try:
        q = jobs.run_every(stream, 1, "append", f"{tmp_path}/c1", lambda b, n: b.count())
        deadline = time.time() + 60
        while not q.recentProgress and time.time() < deadline:
            time.sleep(0.2)
        q.stop()
        with pytest.raises(Exception, match="no luck"):
            jobs.run_to_end(stream, "append", f"{tmp_path}/c2", broken)
        wanted = {"started": 2, "ended": 1, "crashed": 1}
        while time.time() < deadline:
            told = listener.read().collect()
            if all(sum(r.event == e for r in told) >= n for e, n in wanted.items()):
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    crashed = [r for r in told if r.event == "crashed"]
    assert len(crashed) == 1 and "no luck" in crashed[0].message
    assert any(r.event == "progress" and r.rows == 3 for r in told)
