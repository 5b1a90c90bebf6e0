import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.operators import deltas, sketches
from forumlens.operators.deltas import Panel, PanelStore
from forumlens.sources.sinks import KeyedTable

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.LongType()), T.StructField("city", T.StringType()), T.StructField("likes", T.LongType())])


def panels():
    return {"all": Panel([]), "cities": Panel([F.col("city")], {"likes": F.col("likes")}, F.col("city") != "none"), "few": Panel([F.col("likes") % 3, F.col("city")])}


def recomputed(rows):
    out = Counter(), Counter()
    for _, _, city, likes in rows:
        keys = [("all", ()), ("few", (None if likes is None else str(likes % 3), city))] + ([("cities", (city,))] if city not in (None, "none") else [])
        for p in keys:
            out[0][p] += 1
            out[1][p] += (likes or 0) if p[0] == "cities" else 0
    return {p: (n, Decimal(out[1][p])) for p, n in out[0].items()}


def told(store):
    return {(r.panel, tuple(r["keys"])): (r.n, r.sums.get("likes", Decimal(0))) for r in store.state().collect()}


def test_panels_follow_corrections_and_repeats(spark, tmp_path):
    rnd, now = random.Random(5), {}
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "k", "t", buckets=8)
    store = PanelStore(spark, f"{tmp_path}/p", panels())
    for n in range(4):
        rows = {k: (k, rnd.randrange(n + 2), rnd.choice(["a", "b", "none", None]), rnd.choice([None, rnd.randrange(9)])) for k in rnd.sample(range(40), 15)}
        for k, r in rows.items():
            if k not in now or r[1] >= now[k][1]:
                now[k] = r
        batch = spark.createDataFrame([*rows.values(), (None, 9, "a", 1)], SCHEMA)
        for _ in range(2):  # a delivery may repeat
            deltas.follow(table, store, batch)
        assert told(store) == recomputed(now.values())
        assert {tuple(r) for r in table.read().collect()} == set(now.values())
    assert store.versions() == table.versions()


def test_a_batch_that_broke_off_between_panels_and_table(spark, tmp_path):
    table, store = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "k", "t"), PanelStore(spark, f"{tmp_path}/p", panels())
    batch = spark.createDataFrame([(1, 1, "a", 2), (2, 1, "b", 3)], SCHEMA)
    store.refresh(deltas.changes(table, batch), 0)
    deltas.follow(table, store, batch)
    assert told(store) == recomputed([(1, 1, "a", 2), (2, 1, "b", 3)])
    with pytest.raises(ValueError, match="version"):
        store.state(7)


def test_the_second_batch_reads_its_buckets_only(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", SCHEMA, "k", "t", buckets=16)
    table.merge(spark.createDataFrame([(k, 1, "a", k) for k in range(400)], SCHEMA))
    changed = deltas.changes(table, spark.createDataFrame([(7, 2, "b", 1), (8, 0, "b", 1)], SCHEMA))
    assert sorted(tuple(r) for r in changed.collect()) == [(7, 1, "a", 7, -1), (7, 2, "b", 1, 1)]
    read = {f.split("bucket=")[1].split("/")[0] for f in changed.inputFiles()}
    assert 1 <= len(read) <= 2


def test_sketches_of_days_merge_within_their_errors(spark):
    rnd = random.Random(2)
    day = lambda n: dt.datetime(2024, 1, 1 + n, 5)
    rows = [(day(rnd.randrange(10)) if n % 50 else None, rnd.choice("xy"), rnd.randrange(3000), rnd.expovariate(1.0)) for n in range(30_000)]
    rows += [(day(2), "x", None, None), (day(3), None, 1, float("nan"))]
    df = spark.createDataFrame(rows, "ts timestamp, key string, member int, value double").filter("not isnan(value) or value is null")
    days = sketches.daily(df, "ts", ["key"], "member", "value")
    assert days.filter("day is not null and key is not null").count() == 20
    for first, last in ((0, 9), (3, 4), (7, 7)):
        got = {r.key: r for r in sketches.over(days, ["key"], [0.1, 0.5, 0.9], dt.date(2024, 1, 1 + first), dt.date(2024, 1, 1 + last)).collect() if r.key}
        for key in "xy":
            inside = [r for r in rows if r[1] == key and r[0] and first <= r[0].day - 1 <= last]
            members, values = len({r[2] for r in inside if r[2] is not None}), [r[3] for r in inside if r[3] is not None]
            assert got[key].n == len(inside) and abs(got[key].members - members) <= sketches.distinct_error() * members
            for q, v in zip((0.1, 0.5, 0.9), got[key].quantiles, strict=True):
                assert abs(sum(x <= v for x in values) / len(values) - q) <= 2 * sketches.RANK_ERROR
    assert sketches.over(days, ["key"], [0.5], dt.date(2025, 1, 1)).count() == 0
