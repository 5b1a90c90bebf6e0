import random
from collections import Counter

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from forumlens.llm import simhash

COLS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
DOCS = T.StructType([T.StructField(n, t) for n, t in COLS])
LABELS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "quality", "toxic")])


def text(rnd, n, words):
    return " ".join(rnd.choices(words, k=n))


def edited(rnd, t, n):
    w = t.split(" ")
    for k in rnd.sample(range(len(w)), n):
        w[k] = f"new{rnd.random():.6f}"
    return " ".join(w)


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(9)
    return ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(3000)]


def jaccard(a, b):
    s = [{tuple(x.lower().split()[k : k + 5]) for k in range(max(1, len(x.split()) - 4))} for x in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_duplicates_are_caught_and_others_stay(spark, words):
    rnd = random.Random(10)
    rows, origin = [], {}
    for k in range(60):
        t = text(rnd, rnd.choice([60, 200, 500]), words)
        rows.append((k, t))
        n = len(t.split())
        for j in range(rnd.choice([0, 1, 2, 30 if k == 7 else 3])):
            i = 1000 + 100 * k + j
            rows.append((i, edited(rnd, t, max(1, n // 100))))
            origin[i] = k
        rows.append((50000 + k, edited(rnd, t, n // 6)))  # too far off to go
    texts = dict(rows)
    near = {i for i, k in origin.items() if jaccard(texts[i], texts[k]) >= 0.8}
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows + [(None, rows[0][1]), (90000, ""), (90001, None)], DOCS_2)).collect()
    kept = [r.doc_id for r in out]
    assert len(kept) == len(set(kept))
    assert {k for k in range(60)} | {50000 + k for k in range(60)} | {None, 90000, 90001} <= set(kept)
    assert len(near & set(kept)) <= 0.02 * len(near)
    assert set(origin) - near <= set(kept) | near


DOCS_2 = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def test_large_buckets_lose_no_link(spark, words):
    """A large family about the threshold: its members are linked to each other and seldom to the original."""
    rnd = random.Random(12)
    base = text(rnd, 300, words)
    rows = [(0, base)]
    for k in range(1, 70):
        w = (rows[rnd.randrange(len(rows))][1] if k % 2 else base).split(" ")
        at = rnd.randrange(260)
        n = rnd.choice([14, 28, 40])
        w[at : at + n] = [f"n{k}x{i}" for i in range(n)]
        rows.append((k, " ".join(w)))
    comp = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows[:i]:
            if comp[i] != comp[j] and jaccard(a, b) >= 0.8:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {x: new if c == old else c for x, c in comp.items()}
    kept = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS_2)).collect()}
    assert kept == set(comp.values()) and 1 < len(kept) < 69


def test_pipeline(spark, words, tmp_path):
    rnd = random.Random(11)
    rows, labels = [], []
    for k in range(400):
        t = text(rnd, rnd.randint(40, 300), words)
        if k % 10 == 0:
            t = " ".join(rnd.choice(words) + "###" for _ in range(80))
        rows.append((k, t, "en", "big" if k % 3 == 0 else f"s{k % 5}", len(t)))
        labels.append((k, int(k % 10 != 0), 0))
    rows += [(1000 + k, rows[k][1].replace(" ", "  "), "en", "s1", 1) for k in range(1, 60) if k % 10]
    rows += [(2000 + k, edited(rnd, rows[k][1], 1), "en", "s2", 1) for k in range(1, 60) if k % 10]
    rows += [(None, None, None, None, None), (3000, "", None, None, 0), (3, rows[3][1], "en", "big", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == [n for n, _ in COLS]
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in rs} for n, rs in seen.items()}
    clean = {k for k in range(400) if k % 10}
    assert clean <= ids["quality"] and not {k for k in range(400) if k % 10 == 0} & ids["quality"]
    assert clean <= ids["exact_dedup"] and not {i for i in ids["exact_dedup"] if i and 1000 <= i < 2000}
    assert Counter(r.doc_id for r in seen["exact_dedup"])[3] == 1
    # The row without an id or a text is a copy of the empty document 3000.
    assert clean <= ids["near_dedup"] and None not in ids["exact_dedup"] and 3000 in ids["near_dedup"]
    texts = {r[0]: r[1] for r in rows}
    assert all(jaccard(texts[i], texts[i - 2000]) < 0.8 for i in ids["near_dedup"] if 2000 <= i < 3000)
    assert ids["mixing"] <= ids["near_dedup"] and ids["packing"] == ids["mixing"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda rs: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rs)
    assert key(whole) == key(seen["packing"])


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
