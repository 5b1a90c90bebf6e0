import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.llm import simhash
from forumlens.llm.components import connected_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def brute_pairs(fps, budget):
    return {(min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & simhash.MASK).bit_count() <= budget}


def brute_classes(rows, width, budget):
    import xxhash

    marks = []
    for i, t in rows:
        words = bytes(t or "", "utf-8").lower().split()
        runs = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in runs]
        marks.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    comp = {k: i for k, (i, _) in enumerate(marks)}
    changed = True
    while changed:
        changed = False
        for x in range(len(marks)):
            for y in range(x):
                if (marks[x][1] ^ marks[y][1]).bit_count() <= budget and comp[x] != comp[y]:
                    comp[x] = comp[y] = min(comp[x], comp[y])
                    changed = True
    return sorted((marks[k][0], marks[k][1], comp[k]) for k in comp)


@pytest.mark.parametrize("unit", [4, 4096])
@pytest.mark.parametrize("budget", [0, 2, 3])
def test_pairs_match_brute_force(spark, unit, budget):
    rnd = random.Random(budget)
    centre = rnd.getrandbits(64)
    fps = {simhash.signed(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3)))) for _ in range(120)}
    fps = sorted(fps | {simhash.signed(rnd.getrandbits(64)) for _ in range(60)} | {0, -1, 1})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.hamming_pairs(df, budget, unit).collect()]
    assert len(got) == len(set(got))
    assert {(min(p), max(p)) for p in got} == brute_pairs(fps, budget)


def test_classes_match_brute_force(spark):
    rnd = random.Random(1)
    words = [f"W{k}é" for k in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 40, 400]))) for _ in range(30)]
    texts = base + base[:5] + [b + " end" for b in base[:10]] + ["", None, " \t\n", "a", "A", "x\x0by"]
    rows = list(enumerate(texts)) + [(3, base[3])]
    out = simhash.near_duplicate_classes(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.fingerprint & simhash.MASK, r.component_id) for r in out) == brute_classes(rows, 3, 2)


def test_empty_null_and_clashing(spark):
    assert simhash.near_duplicate_classes(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(None, "a b", 1), (2, "a b", 1), (None, "z", 2)], "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicate_classes(df).collect()}
    assert got == {(None, 2), (2, 2), (None, None)}


def test_components_of_a_long_path(spark):
    rnd = random.Random(2)
    ids = list(range(200))
    rnd.shuffle(ids)
    edges = spark.createDataFrame([(a, b) for a, b in zip(ids[:150], ids[1:150])] + [(ids[150], ids[151]), (ids[5], ids[5])], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert {got[i] for i in ids[:150]} == {min(ids[:150])}
    assert got[ids[150]] == got[ids[151]] == min(ids[150:152])


def jaccard_components(rows, width, similarity):
    """Smallest id of each id's component, by all pairs that share a shingle."""
    sets = {i: set(simhash.shingle_hashes(t, width).tolist()) for i, t in rows}
    holders, comp = {}, {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            comp[i] = i = comp[comp[i]]
        return i

    for i, s in sets.items():
        for j in {j for h in s for j in holders.get(h, ())}:
            both = len(s & sets[j])
            if both >= similarity * (len(s) + len(sets[j]) - both):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
        for h in s:
            holders.setdefault(h, []).append(i)
    return {i: root(i) for i in sets}


def kept_ids(spark, rows):
    return {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}


def test_families_of_short_texts(spark):
    rnd = random.Random(3)
    rows = []
    for f in range(60):
        # Members of a family share a run of words, but most of them are no near duplicates.
        core = [f"f{f}w{k}" for k in range(20)]
        for _ in range(50):
            n = rnd.randint(8, 20)
            own = rnd.choice((0, 0, 1, 2, 4))
            words = core[: n - own] + [f"x{rnd.randint(0, 6)}" for _ in range(own)]
            rows.append(" ".join(words) if rnd.random() < 0.5 else " ".join([f"y{rnd.randint(0, 6)}", *words]))
    rows = list(enumerate(rows))
    comp = jaccard_components(rows, 5, 0.8)
    gone = {i for i, _ in rows} - kept_ids(spark, rows)
    want = {i for i, c in comp.items() if i != c}
    assert gone <= want and len(gone) >= 0.99 * len(want)


def test_recall_on_planted_pairs(spark):
    """1,200 pairs of similarity 0.8 to 1 among unrelated texts, by brute force over all rows."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(1200):
        w = rnd.choices(words, k=rnd.choice((25, 60, 150, 400)))
        rows.append((2 * k, " ".join(w)))
        n = len(w)
        most = n // 9  # shingles that may be lost on one side
        if k % 2:  # words in a row, at the end or at the start
            cut = rnd.randint(1, max(1, most))
            w = w[cut:] + rnd.choices(words, k=cut) if k % 4 == 1 else w[:-cut]
        else:  # single words
            for at in rnd.sample(range(n), max(1, rnd.randint(0, most // 5))):
                w[at] = f"n{rnd.random()}"
        rows.append((2 * k + 1, " ".join(w)))
    comp = jaccard_components(rows, 5, 0.8)
    want = {i for i, c in comp.items() if i != c}
    gone = {i for i, _ in rows} - kept_ids(spark, rows)
    assert len(want) > 900 and gone <= want and len(gone) >= 0.98 * len(want)


@pytest.mark.parametrize("n", [9, 50, 400])
def test_bits_differ_by_half_of_the_dissimilarity(n):
    rnd = np.random.default_rng(n)
    shared, bits = round(0.8 * n), []
    for _ in range(300):
        u = rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        rest = n - shared
        x, y = simhash.skewed_fingerprints(u[: shared + rest // 2]), simhash.skewed_fingerprints(np.concatenate([u[:shared], u[shared + rest // 2 :]]))
        bits.append(np.bitwise_count(x ^ y))
    bits = np.asarray(bits)
    assert abs(bits.mean() / simhash.SKEWED_BITS - (1 - shared / n) / 2) < 0.01
    assert (bits <= simhash.SKEWED_BUDGET).any(axis=1).mean() > 0.95


@pytest.mark.parametrize("thin", [simhash.forest, simhash.stars])
def test_fewer_links_still_reach(thin):
    rnd = random.Random(5)
    n = 60
    edges = sorted({(a, b) for a, b in ((rnd.randrange(n), rnd.randrange(n)) for _ in range(150)) if a < b})
    i, j = (np.asarray([e[k] for e in edges]) for k in (0, 1))
    a, b = thin(i, j, n)
    assert {tuple(sorted(e)) for e in zip(a.tolist(), b.tolist(), strict=True)} <= set(edges) and len(a) <= n
    assert set(a.tolist()) | set(b.tolist()) == {x for e in edges for x in e}
    if thin is simhash.forest:
        comp = lambda es: connected(n, es)
        assert comp(zip(a.tolist(), b.tolist(), strict=True)) == comp(edges)


def connected(n, edges):
    comp = list(range(n))
    for a, b in edges:
        old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
        comp = [new if c == old else c for c in comp]
    return comp


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    long = " ".join(f"v{k}" for k in range(200_000))
    rows = [("b", long, 1, 2), ("a", long + " end", 1, 2), ("c", "x y z", 3, 4), ("c", "x y z", 3, 4), ("d", "X Y Z", 0, 0), (None, "x y z", 0, 0), ("e", None, 0, 0), ("f", "", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id string, text string, gone int, GONE_ int")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or "") for r in out.collect()) == ["", "a", "c", "c", "e", "f"]
    empty = simhash.drop_near_duplicates(df.limit(0))
    assert empty.count() == 0 and empty.columns == df.columns
    # A document of two texts links the texts that are close to either.
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "p q r s t u v"), (3, "p q r s t u v")]
    assert kept_ids(spark, rows) == {1}


def test_large_nodes_are_parted(spark):
    """Equal fingerprints beyond a task's unit are parted by the hashes of the items."""
    items = spark.range(300).selectExpr("id", "id as comp", "1 as size", "1 as common", "true as open", "0 as table", "id % 3 as fp")
    rows = simhash.trie_rows(items, 36, 3)
    for apart, least in ((True, 300 * 299 // 2), (False, 20)):
        got = {(min(r), max(r)) for r in simhash.trie_join(rows, 36, 3, unit=64, apart=apart, thin=None if apart else simhash.stars).collect()}
        assert all(a != b for a, b in got) and len(got) >= least
    # Nothing is left to pair within one component.
    one = simhash.trie_rows(items.withColumn("comp", F.lit(0).cast("long")), 36, 3)
    assert simhash.trie_join(one, 36, 3, unit=64).count() == 0


def test_farthest_is_a_quantile_of_the_binomial():
    rnd = np.random.default_rng(1)
    far = simhash.farthest(252, 0.1)
    drawn = rnd.binomial(252, 0.1, 1_000_000)
    assert (drawn > far).mean() <= 1.2e-3 < (drawn > far - 1).mean() * 1.2
    assert simhash.farthest(252, 0.0) == 0 and simhash.farthest(10, 0.5, 0.0) == 10


def test_components_write_two_tables_a_round(spark, monkeypatch):
    """Labels are made at the end and not written each round: the driver plans and keeps a table less for each."""
    from forumlens.llm import components

    made = []
    monkeypatch.setattr(components, "written", lambda df, f=components.written: made.append(f(df)) or made[-1])
    path = [(k * 7 % 31, (k + 1) * 7 % 31) for k in range(30)] + [(100, 100), (201, 200)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 200: 200, 201: 200}
    rounds = sum(df.columns == ["x", "y"] for df in made)
    assert rounds > 1 and len(made) == 1 + 2 * rounds
