import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.llm import mixing, topk

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("norm", T.StringType())])


def brute(rows, k):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, x) in enumerate(ok):
        if q % 50 == 0:
            got = sorted((-sum(a * b for a, b in zip(x, y)), c) for m, (c, y) in enumerate(ok) if m != n)[:k]
            out.update((q, r + 1, c, -s) for r, (s, c) in enumerate(got))
    return out


def search(df, **kw):
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, **kw).select("query_id", "rank", "vec_id", "score")
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("kind", ["unit", "scaled", "ties", "huge", "few"])
def test_top_k_is_exact(spark, kind):
    rnd = np.random.default_rng(13)
    n = 4 if kind == "few" else 900
    x = rnd.normal(size=(n, 12))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "scaled":
        x *= rnd.lognormal(0, 2, (n, 1))
    if kind == "ties":
        x = np.repeat(x[:3], n // 3, axis=0)
    if kind == "huge":
        x *= 1e6
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(2000, None), (2050, [None] + [1.0] * 11), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [0.0] * 12), (2250, []), (None, [1.0] * 12), (2300, [0.5, -0.5])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    assert search(df, rows=128, queries=7 if kind == "scaled" else 1000) == brute(rows, 5)


def test_rows_that_share_an_id_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (2, [2.0, 3.0]), (0, [1.0, 0.0]), (50, [0.5, 0.25])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    got = search(df, queries=2)
    assert got == brute(rows, 5)
    assert got[0, 1, 1, 327680] == got[0, 2, 1, 327680] == 2


def test_top_k_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert search(empty) == Counter()


def test_pruning_leaves_most_products_out():
    rnd = np.random.default_rng(14)
    v = np.floor(256 * rnd.normal(size=(2000, 16)) * rnd.lognormal(0, 1.5, (2000, 1)) * np.linspace(1, 0.01, 16))
    v = v[np.argsort(-np.linalg.norm(v, axis=1))]
    seen = []
    whole = topk.exact_products
    try:
        topk.exact_products = lambda q, w: seen.append(q.shape[0] * w.shape[0]) or whole(q, w)
        _, _, turn = np.linalg.svd(v, full_matrices=False)
        found = topk.Search(v[:50], np.arange(50), np.full(50, -np.inf), turn.T, 5)
        found.add(v, np.arange(2000), np.arange(2000), np.linalg.norm(v, axis=1))
    finally:
        topk.exact_products = whole
    assert sum(seen) < 0.5 * 50 * 2000


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("rate", T.StringType()), T.StructField("mix_copy", T.StringType())])


def documents(n=3000):
    rows = [(k, "x" * (k % 50), "hot" if k % 3 == 0 else f"s{k % 4}", "clash", "old") for k in range(n)]
    return rows + [(None, None, None, None, None), (None, "", None, None, None), (4, "again", "s0", None, None)]


def poisson_count(rate, u):
    k, p, c = 0, math.exp(-rate), math.exp(-rate)
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_draws_are_inverted_poisson(spark):
    import hashlib

    rows = documents()
    weights = {"hot": 1.0, "s0": 2.0, "s1": 3.0, "s2": 0.0, "absent": 9.0}
    size = Counter()
    for _, t, s, *_ in rows:
        size[s] += len(t or "") + 1
    here = {s: weights.get(s, 0.0) for s in size}
    rate = {s: here[s] / sum(here.values()) * sum(size.values()) / size[s] for s in size}
    want = Counter()
    for i, _, s, *_ in rows:
        u = int(hashlib.md5(f"mix\x1f{mixing.NULL if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        want[i, s] += poisson_count(rate[s], u)
    out = mixing.mix(spark.createDataFrame(rows, DOCS), weights=weights)
    assert out.columns == ["doc_id", "text", "source", "rate", "mix_rate", "mix_copies", "mix_copy", "mix_order"]
    got = out.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter({k: n for k, n in want.items() if n})
    shares = Counter()
    for r in got:
        shares[r.source] += len(r.text or "") + 1
    assert abs(shares["s1"] / sum(shares.values()) - 0.5) < 0.05 and "s2" not in shares
    assert [r.mix_order for r in got] == sorted(r.mix_order for r in got)


def test_large_and_small_rates():
    for rate in (0.01, 1.0, 30.0, 2000.0, 5e5):
        first, steps = mixing.poisson_steps(rate)
        mean = sum((first + i) * (b - a) for i, (a, b) in enumerate(zip([0.0, *steps], steps)))
        assert abs(mean - rate) < 1e-6 * rate + 1e-9
        assert 1 - steps[-1] < 1e-9 and len(steps) < 40 * math.sqrt(rate) + 100
    assert mixing.poisson_steps(0) == (0, [1.0])


def test_many_sources_and_nothing(spark, monkeypatch):
    rows = documents(300)
    few = Counter((r.doc_id, r.mix_copy) for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect())
    monkeypatch.setattr(mixing, "FEW", 1)
    assert Counter((r.doc_id, r.mix_copy) for r in mixing.mix(spark.createDataFrame(rows, DOCS)).collect()) == few
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_a_component_too_large_to_scale_takes_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1e307, 0.0]), (3, [-1e307, 1.0]), (4, [0.5, 0.5])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), F.col("vec_id") < 4, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == [(0, 1, 1, 4 * 65536), (0, 2, 4, 98304), (1, 1, 0, 4 * 65536), (1, 2, 4, 98304)]


def test_a_source_column_with_a_dot(spark):
    df = spark.createDataFrame([(k, "some text", f"s{k % 2}") for k in range(50)], "doc_id int, text string, `my.source` string")
    out = mixing.mix(df, source_col="my.source", epochs=2.0)
    assert out.columns[:3] == df.columns and out.count() > 50
