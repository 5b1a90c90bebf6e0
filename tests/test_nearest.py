import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlens.operators import nearest
from forumlens.operators.nearest import VectorIndex

DIM = 24


def vectors(n=1500, groups=30, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, DIM))
    m = centres[rnd.integers(0, groups, n)] + 0.4 * rnd.normal(size=(n, DIM))
    rows = [(i, [float(x) for x in v], int(i % 7), "x") for i, v in enumerate(m)]
    rows[5], rows[6] = (5, None, 1, "x"), (6, [0.0] * DIM, 1, "x")
    rows[7] = (7, [1.0] * (DIM - 1), 1, "x")
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(vectors(), "id long, v array<double>, label int, `cell` string")


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    return VectorIndex.build(rows, "id", "v", str(tmp_path_factory.mktemp("v") / "index"), {"label": "label"}, buckets=4, splits=2)


def asked(rows, least=0, step=37):
    return rows.filter((F.col("id") % step == 0) & (F.col("id") >= least)).select(F.col("id").alias("query"), F.col("v").alias("vector"))


def exact(k, labels, step=37):
    data = [r for r in vectors() if r[1] is not None and len(r[1]) == DIM]
    m, out = nearest.unit(np.array([r[1] for r in data])), {}
    for q in [r for r in data if r[0] % step == 0]:
        scores = m @ nearest.unit(np.array([q[1]]))[0]
        best = sorted(((-round(float(s), 6), r[0]) for s, r in zip(scores, data, strict=True) if r[2] in labels))[:k]
        out[q[0]] = [i for _, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query, r["rank"])):
        out.setdefault(r.query, []).append(r.id)
    return out


@pytest.mark.parametrize("labels", [range(7), (2,), (1, 4)])
def test_all_cells_are_exact_and_few_recall_nine_in_ten(rows, index, labels):
    where, want = F.col("about.label").isin(*labels), exact(10, labels)
    assert found(index.nearest(asked(rows), 10, where=where, probes=len(index.centres))) == want
    got = found(index.nearest(asked(rows), 10, where=where))
    assert index.probes < len(index.centres) / 2
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(want[q]) for q in want)


def test_every_row_is_indexed_and_filters_hold_before_ranks(rows, index):
    ids = {r.id for r in index.rows().select("id").collect()}
    assert ids == {r[0] for r in vectors()} - {5, 7}
    rare = F.col("about.label").isin(3) & (F.col("id") % 100 == 3)
    n = rows.filter("label = 3 and id % 100 = 3").count()
    got = found(index.nearest(asked(rows), 10, where=rare, probes=1))
    assert 0 < n < 10 and all(len(v) == n for v in got.values()) and len(got) == len(exact(1, range(7)))


def test_few_cells_read_few_folders(index):
    read = index.rows([0]).select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("bucket=0" in r.f for r in read)


def test_bounds_and_edges(spark, rows, index, tmp_path, monkeypatch):
    none = VectorIndex.build(rows.limit(0), "id", "v", str(tmp_path / "none"))
    assert none.nearest(asked(rows).limit(0), 3).count() == 0
    one = VectorIndex.build(rows.filter("id = 9"), "id", "v", str(tmp_path / "one"))
    assert found(one.nearest(asked(rows, step=9).filter("query < 20"), 3)) == {0: [9], 9: [9], 18: [9]}
    zero = index.nearest(spark.createDataFrame([(1, [0.0] * DIM)], "query int, vector array<double>"), 3).collect()
    assert len(zero) == 3 and {r.score for r in zero} == {0.0}
    monkeypatch.setattr(nearest, "MAX_QUERIES", 2)
    with pytest.raises(ValueError, match="queries"):
        index.nearest(asked(rows), 3)
