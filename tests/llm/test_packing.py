import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import types as T

from forumlens.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())])


def unroll(runs, capacity):
    """Every place of a plan; checks rooms and numbers."""
    numbers = defaultdict(list)
    for r in runs:
        assert sum(s * c for s, c, _ in r.holds) == capacity - r.room <= capacity
        for size, each, first in r.holds:
            numbers[size] += range(first, first + each * r.n)
    return {s: sorted(v) for s, v in numbers.items()}


@pytest.mark.parametrize("seed", range(8))
def test_plans_are_whole_and_tight(seed):
    rnd = random.Random(seed)
    top = [1023, 700, 400, 1023][seed % 4]
    counts = defaultdict(int)
    for _ in range([30, 500, 5000, 20000][seed % 4]):
        counts[max(1, min(1024, int(rnd.lognormvariate(5.5, 0.8)) if seed < 4 else rnd.randint(200, top)))] += 1
    for groups in [(16,), packing.GROUPS]:
        found = packing.plan(counts, 1024, groups)
        assert unroll(found.runs, 1024) == {s: list(range(n)) for s, n in counts.items()}
        assert found.groups and found.configured
    least = -(-sum(s * c for s, c in counts.items()) // 1024)
    assert least <= found.sequences <= min(best_fit(counts, 1024) * 1.005 + 1, least * 1.5 + 1)


def best_fit(counts, capacity):
    p = packing.Planner(counts, capacity)
    p.best_fit()
    return sum(r.n for rs in p.open.values() for r in rs)


def test_grouping_beats_plain_best_fit():
    rnd = random.Random(0)
    counts = Counter(rnd.randint(260, 512) for _ in range(4000))
    found = packing.plan(counts, 1024)
    assert found.sequences < 0.96 * best_fit(counts, 1024) and found.configured > 0.9 * found.sequences
    # Three pieces of 260 to 340 fit a sequence, and not two of the longest.
    counts = {520: 300, 350: 300, 154: 300, 342: 300, 341: 600}
    assert packing.plan(counts, 1024).sequences <= best_fit(counts, 1024)


def optimum(sizes, capacity):
    """Fewest sequences, by trying every way."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[k]:
                at = rooms.index(r)
                go(k + 1, [*rooms[:at], r - sizes[k], *rooms[at + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_tiny_plans_against_the_optimum():
    rnd = random.Random(1)
    more = 0
    for _ in range(60):
        sizes = sorted((rnd.randint(2, 20) for _ in range(rnd.randint(1, 10))), reverse=True)
        found = packing.plan(Counter(sizes), 20)
        best = optimum(sizes, 20)
        assert best <= found.sequences <= best + 1
        more += found.sequences - best
    assert more <= 3


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_pack_round_trip(spark):
    rnd = random.Random(5)
    rows = [(k, " ".join(rnd.choices(["the", "wörd", "a,", "b-c"], k=rnd.choice([0, 3, 40, 300, 900, 4000]))), "x") for k in range(150)]
    rows += [(5, None, None), (None, "no id", None), (None, None, None), (7, rows[7][1], "x")]
    out = packing.pack(spark.createDataFrame(rows, DOCS), PATH).collect()
    t = bpe.load(PATH)
    want = defaultdict(int)
    for i, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, s, n, zlib.crc32(bpe.ids_bytes(ids[s : s + n]))] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in out:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_ids_of_any_type_and_long_texts(spark):
    rows = [("a", "x " * 300_000, 1, 2), ("a", "x " * 300_000, 1, 2), (None, None, 0, 0), ("b", "", 0, 0)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id string, text string, piece int, PART int"), PATH).collect()
    size = len(bpe.load(PATH).encode(rows[0][1], add_special_tokens=False).ids) + 1
    assert sorted((r.doc_id or "", r.length) for r in out if r.doc_id != "a") == [("", 1), ("b", 1)]
    assert sum(r.length for r in out if r.doc_id == "a") == 2 * size and len({(r.sequence_id, r.offset) for r in out}) == len(out)
