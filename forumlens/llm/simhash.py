"""SimHash near-deduplication by a binary-trie self-join.

Fingerprints form a binary trie, and pairs of its nodes are traversed together: a pair carries the bits in which its
prefixes differ, and is dropped when they exceed the budget. At most b differing bits leave one of b + 1 disjoint blocks
equal, so that for each block, rotated to the front, the traversal starts at the pairs (p, p) of that depth. A pair with
few items below it goes to one task, which walks the rest of the trie; a pair with many goes further down in a Spark join
first, again and again, so that no task holds a large node. Bits of a hash of the item follow the fingerprint, so that
items of equal fingerprints can be parted too. A pair of nodes that hold one and the same component is dropped.

Two fingerprints are used. Exact links on one fingerprint a text (near_duplicate_classes) take the plain majority of
shingle hashes. Links by similarity (similar_components) take several fingerprints of skewed weights (see
skewed_fingerprints), whose distance follows the Jaccard similarity, and verify each candidate on the whole shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.components import connected_components
from forumlens.llm.shared import scratch, spare, text_or_empty, written

BITS = 64
MASK = (1 << BITS) - 1
#: Bits by which a pair of large nodes goes down at a time.
STEP = 6
#: A node pair goes to one task if the product of its items is at most this.
UNIT = 1 << 18
#: Within a task, nodes of at most this product are compared at once.
BLOCK = 1 << 16


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` words joined by spaces; of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(s, 42) for s in runs), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << int(k) for k in np.nonzero(2 * ones > len(hashes))[0])


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(width: int):
    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(majority_bits(shingle_hashes(t, width))) for t in texts], dtype="int64")

    return simhash


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth < BITS else value


def _turned(fp: Column, bits: int, by: int) -> Column:
    """The lowest `bits` bits of fp, rotated left, at the top of 64 bits."""
    top = F.shiftleft(fp, BITS - bits) if bits < BITS else fp
    if not by:
        return top
    low = F.shiftrightunsigned(top, BITS - by)  # the bits that come round
    return F.shiftleft(top, by).bitwiseOR(F.shiftleft(low, BITS - bits))


#: What is known of an item: its component, its size, how much of that it has in common with any other, and whether it
#: still looks for a link. Further columns f0, f1 and so on are its fingerprints by table.
ITEM = {"v": "long", "id": "long", "comp": "long", "size": "int", "common": "int", "open": "boolean"}


def trie_rows(items: DataFrame, bits: int, budget: int) -> DataFrame:
    """(turn, v, ...): each fingerprint `fp` of an item and `table`, with each of its blocks in front."""
    width, turns = bits // (budget + 1), budget + 1
    tail = F.shiftrightunsigned(F.xxhash64("id"), bits) if bits < BITS else F.lit(0).cast("long")
    each = [F.struct((F.col("table") * turns + r).cast("int").alias("turn"), _turned(F.col("fp"), bits, width * r).bitwiseOR(tail).alias("v")) for r in range(turns)]
    rest = [c for c in items.columns if c not in ("table", "fp")]
    return items.select(F.explode(F.array(*each)).alias("t"), *rest).select("t.turn", "t.v", *rest)


def walk_trie(x: np.ndarray, y: np.ndarray | None, depth: int, diff: int, bits: int, budget: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of values within the budget, of sorted values below two trie nodes; y None: below one, each pair once.

    diff: the bits in which the nodes' prefixes of `depth` bits differ.
    """
    shift, inner = np.uint64(BITS - bits), y is None
    other = x if inner else y
    todo = [(0, len(x), 0, len(other), inner, depth, diff)]
    while todo:
        a, b, c, d, same, at, n = todo.pop()
        if a == b or c == d or (same and b - a < 2):
            continue
        if (b - a) * (d - c) <= block or at >= bits:
            for s in range(a, b, max(1, block // (d - c))):
                part = x[s : min(b, s + max(1, block // (d - c)))]
                near = np.bitwise_count((part[:, None] ^ other[None, c:d]) >> shift) <= budget
                i, j = np.nonzero(near)
                i, j = i + s, j + c
                if same:
                    i, j = i[i < j], j[i < j]
                yield i, j
            continue
        bit = np.uint64(1 << (BITS - 1 - at))
        prefix = ~np.uint64((1 << (BITS - at)) - 1)
        m = a + int(np.searchsorted(x[a:b], (x[a] & prefix) | bit))
        k = m if same else c + int(np.searchsorted(other[c:d], (other[c] & prefix) | bit))
        todo += [(a, m, c, k, same, at + 1, n), (m, b, k, d, same, at + 1, n)]
        if n < budget:
            todo.append((a, m, k, d, False, at + 1, n + 1))
            if not same:
                todo.append((m, b, c, k, False, at + 1, n + 1))


def _first_block(x: np.ndarray, turn: int, bits: int, width: int) -> np.ndarray:
    """Whether values that differ in x agree in none of the blocks before that of the turn."""
    ok = np.ones(len(x), bool)
    for k in range(turn):
        low = np.uint64(BITS - (bits - turn * width + (k + 1) * width))
        ok &= (x >> low) & np.uint64((1 << width) - 1) != 0
    return ok


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (i, j) among n nodes, some that connect what all of them connect; fewer than n."""
    root, keep = list(range(n)), []
    for e, (p, q) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(e)
    return i[keep], j[keep]


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (i, j) among n nodes one for each node that has any: to its neighbour of most edges."""
    degree = np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    best = np.lexsort((a, -degree[a], b))
    a, b = a[best], b[best]
    first = np.ones(len(b), bool)
    first[1:] = b[1:] != b[:-1]
    return a[first], b[first]


def _walker(bits: int, budget: int, thin: Callable | None, similarity: float, far: int | None, names: list[str]):
    """Node pairs with their items to pairs (a, b) of ids."""
    width, turns = bits // (budget + 1), budget + 1
    n_tables = sum(c not in ITEM for c in names)

    def lists(batch: pa.RecordBatch, side: str) -> Callable:
        cols = [batch.column(f"{side}{c}") for c in names]
        ends, held = cols[0].offsets.to_numpy(), [c.values.to_numpy(zero_copy_only=False) for c in cols]

        def get(k: int) -> list[np.ndarray]:
            v, *rest = (h[ends[k] : ends[k + 1]] for h in held)
            v = v.view(np.uint64)
            order = np.argsort(v, kind="stable")
            return [v[order], *(r[order] for r in rest)]

        return get

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = lists(batch, "x"), lists(batch, "y")
            turn, depth, diff, alone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("turn", "depth", "diff", "alone"))
            found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for k in range(batch.num_rows):
                x = left(k)
                y = x if alone[k] else right(k)
                pieces = []
                for i, j in walk_trie(x[0], None if alone[k] else y[0], int(depth[k]), int(diff[k]), bits, budget):
                    ok = x[2][i] != y[2][j]
                    if similarity:
                        # Similar sets have so much in common, of which neither has more than its own.
                        ok &= np.minimum(x[4][i], y[4][j]) >= similarity / (1 + similarity) * (x[3][i] + y[3][j]) - 1e-6
                    i, j = i[ok], j[ok]
                    ok = _first_block(x[0][i] ^ y[0][j], int(turn[k]) % turns, bits, width)
                    for f in range(min(n_tables, int(turn[k]) // turns)):  # a pair is reported by its first table
                        ok &= np.bitwise_count(x[len(ITEM) + f][i] ^ y[len(ITEM) + f][j]) > budget
                    if far is not None:
                        ok &= sum(np.bitwise_count(x[c][i] ^ y[c][j]).astype(np.int32) for c in range(len(ITEM), len(names))) <= far
                    pieces.append((i[ok], j[ok]))
                i, j = (np.concatenate([p[s] for p in pieces]) if pieces else np.zeros(0, np.int64) for s in (0, 1))
                a, b = x[1], y[1]
                if thin and len(i):
                    looks = x[5]
                    if not alone[k]:
                        a = b = np.concatenate([x[1], y[1]])
                        looks, j = np.concatenate([x[5], y[5]]), j + len(x[1])
                    i, j = thin(i, j, len(a))
                    i, j = i[looks[j]], j[looks[j]]
                found.append((a[i], b[j]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[s] for f in found])) for s in (0, 1)], ["a", "b"])

    return walk


def trie_join(rows: DataFrame, bits: int, budget: int, unit: int = UNIT, thin: Callable | None = None, apart: bool = True, similarity: float = 0.0, far: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids of trie_rows() of unequal `comp` within the budget, some of them more than once.

    thin: what to hand on of the links found in one task, all by default. apart False: nodes are joined with themselves
    only, so that the work is in proportion to the rows. similarity: least Jaccard similarity that sets of the items'
    sizes, and of what they have in common with any, must be able to have. far: bits in which the fingerprints of all
    tables together may differ, where items carry them.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields if f.name != "turn"}
    names = [*ITEM, *(c for c in kinds if c not in ITEM)]
    depth, walk, out = bits // (budget + 1), _walker(bits, budget, thin, similarity, far, names), None
    small = F.col("na") * F.col("nb") <= unit
    held = [F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")]
    nodes = rows.groupBy("turn", _prefix(F.col("v"), depth).alias("p")).agg(*held).filter("n > 1 and low <> high")
    front = written(nodes.select("turn", F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0).alias("diff"), F.col("n").alias("na"), F.col("n").alias("nb")))
    while True:
        ready = front if depth == BITS else front.filter(small)
        wanted = ready.select("turn", F.col("a").alias("p")).union(ready.select("turn", F.col("b"))).distinct()
        under = rows.withColumn("p", _prefix(F.col("v"), depth)).join(wanted, ["turn", "p"])
        under = under.groupBy("turn", "p").agg(F.collect_list(F.struct(*names)).alias("xs"))
        side = lambda node, s: under.select("turn", F.col("p").alias(node), *[F.col(f"xs.{c}").alias(f"{s}{c}") for c in names])
        cols = ["turn", F.lit(depth).alias("depth"), "diff", (F.col("a") == F.col("b")).alias("alone")]
        lists = lambda s: [f"{s}{c}" for c in names]
        # A node with itself needs its items once.
        none = [F.array().cast(f"array<{kinds[c]}>").alias(f"y{c}") for c in names]
        same = ready.filter("a = b").join(side("a", "x"), ["turn", "a"]).select(*cols, *lists("x"), *none)
        whole = same
        if apart:
            other = ready.filter("a <> b").join(side("a", "x"), ["turn", "a"]).join(side("b", "y"), ["turn", "b"])
            whole = same.unionByName(other.select(*cols, *lists("x"), *lists("y")))
        found = written(whole.mapInArrow(walk, "a long, b long"))
        out = found if out is None else out.union(found)
        large = front.filter(~small)
        if depth == BITS or large.isEmpty():
            return out
        step = min(STEP, BITS - depth)
        split = large.select("turn", F.col("a").alias("p")).union(large.select("turn", F.col("b"))).distinct()
        below = rows.withColumn("p", _prefix(F.col("v"), depth)).join(split, ["turn", "p"], "left_semi")
        kids = written(below.groupBy("turn", "p", _prefix(F.col("v"), depth + step).alias("c")).agg(*held))
        kid = lambda node, c, k: kids.select("turn", F.col("p").alias(node), F.col("c").alias(c), *[F.col(n).alias(n + k) for n in ("n", "low", "high")])
        more = large.join(kid("a", "ca", "1"), ["turn", "a"]).join(kid("b", "cb", "2"), ["turn", "b"])
        # Of the fingerprint's bits only: those of the item's hash part items and don't count.
        counted = max(0, min(step, bits - depth))
        unlike = F.bit_count(F.shiftrightunsigned(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND((1 << step) - 1), step - counted)) if counted else F.lit(0)
        more = more.withColumn("diff", F.col("diff") + unlike).filter(F.col("diff") <= budget)
        more = more.filter("a <> b or ca < cb or (ca = cb and n1 > 1)" if apart else "ca = cb and n1 > 1")
        more = more.filter("least(low1, low2) <> greatest(high1, high2)")
        front = written(more.select("turn", F.col("ca").alias("a"), F.col("cb").alias("b"), "diff", F.col("n1").alias("na"), F.col("n2").alias("nb")))
        depth += step


def hamming_pairs(fps: DataFrame, budget: int, unit: int = UNIT, thin: Callable | None = None) -> DataFrame:
    """Pairs (a, b) of the distinct longs `fp` that differ in at most `budget` bits, each pair once.

    thin=forest: where many are close, only so many pairs as connect them.
    """
    if not 0 <= budget < 16:
        raise ValueError("the budget must be 0 to 15 bits")
    items = fps.select(F.col("fp").alias("id"), F.col("fp").alias("comp"), F.lit(1).alias("size"), F.lit(1).alias("common"), F.lit(True).alias("open"), F.lit(0).alias("table"), "fp")
    return trie_join(written(trie_rows(items, BITS, budget)), BITS, budget, unit, thin)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """One row per row of `docs`: id, fingerprint (long), component_id (smallest id that links reach).

    Fingerprints of at most `budget` differing bits are linked; equal ones are one node of the graph, so that copies
    are never expanded into pairs, and where a trie node holds many close ones, a spanning forest of their links stands
    for them. Texts without words, null ones too, have fingerprint zero and are linked like any other. Very long texts
    are read whole; their hashes are counted in parts. Null ids get the component of the others and are never its id,
    unless no other is there. Ids may be of any type that has an order. Repeated rows come out as often as they come
    in; an empty table gives an empty result; other columns are not read, so that their names cannot clash.
    """
    marks = written(docs.select(F.col(f"`{id_col}`").alias("id"), fingerprint(width)(text_or_empty(text_col)).alias("fp")))
    with scratch(docs.sparkSession) as keep:
        groups = keep(marks.groupBy("fp").agg(F.min("id").alias("least")))
        labels = keep(connected_components(hamming_pairs(groups.select("fp"), budget, thin=forest)))
    classes = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = classes.select("fp", "label").join(least, "label").select("fp", "component_id")
    return marks.join(found, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


#: Fingerprints of a text for similarity search, their bits, and the bits in which two may differ. Texts of similarity
#: 0.8 differ in a bit with probability 0.1, so that a fingerprint pair is within the budget in half of the cases and one
#: of seven in 99.3 %. Unrelated texts are in 2**-23 of the cases: with many billions of texts take more bits and tables.
TABLES, SKEWED_BITS, SKEWED_BUDGET = 7, 36, 3
#: Tables in the order in which items look for their first link.
SEARCHED = ((0,), (1, 2), (3, 4, 5, 6))


#: Share of pairs at the least similarity that the distance over all tables may leave out.
MISSED = 1e-3


def farthest(bits: int, differs: float, missed: float = MISSED) -> int:
    """The number of differing bits that is exceeded with a probability of at most `missed`, each differing by itself."""
    seen = 0.0
    for d in range(bits + 1):
        seen += math.comb(bits, d) * differs**d * (1 - differs) ** (bits - d)
        if seen >= 1 - missed:
            return d
    return bits


def skewed_fingerprints(hashes: np.ndarray, tables: int = TABLES, bits: int = SKEWED_BITS) -> np.ndarray:
    """SimHashes of skewed weights: `tables` numbers of `bits` bits, of the distinct shingle hashes of a text.

    For each bit the shingles get weights of their own, so skewed that the largest outweighs all others together: the
    weighted majority is then the bit of that shingle, which is the first in the order of a hash. Two texts of Jaccard
    similarity j have the same first shingle with probability j, and differ in the bit with (1 - j) / 2, whatever their
    sizes; with equal weights it would be more for the same j (0.15 instead of 0.1 at 0.8) and depend on the sizes.
    """
    k = np.arange(1, tables * bits + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    k = (k ^ (k >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    turn = (k >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    first = np.empty(len(turn), np.uint32)
    step = max(1, (1 << 19) // max(1, len(h)))
    for at in range(0, len(turn), step):
        order = h[None, :] * turn[at : at + step, None]
        order ^= order >> np.uint32(15)
        order *= np.uint32(0x2C1B3C6D)
        first[at : at + step] = order.min(axis=1)
    # Each bit takes another bit of its shingle's hash.
    mixed = (first ^ turn) * np.uint32(0x297A2D39)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    ones = (mixed >> np.uint32(31)).astype(np.int64).reshape(tables, bits)
    return ones @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _set_keys(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes: sums of two hashes of each."""
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    sums = [int(x.sum(dtype=np.uint64)) for x in (h, mixed ^ (mixed >> np.uint64(29)))]
    return signed(sums[0]), signed(sums[1])


def similar_sets(base: DataFrame, width: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """((id, node), (node, label)): the set of each row of (id, text) by number, and the components of similar sets.

    Texts without words have no node. Equal sets are one node. Candidates are pairs within the budget in any of the
    tables, found by trie joins, each of which leaves out what is in one component by then:

    1. nodes of the trie with themselves only, of one turn a table, hand on a link for each item;
    2. all nodes hand on a link for each item that has any, a few tables after the other, until it has one, which is
       tried; items without any are done;
    3. of the items of these links those whose sets have enough in common with any other of them go on: first those
       without a component try a link in each place of the trie, and then all pairs are found that are left. These
       carry all fingerprints, and pairs that differ in more of all bits than similar ones do but for one in a thousand
       (41 of 252 at 0.8) are no candidates: a family just below the similarity has many pairs within one table's budget.

    Each candidate is verified on the whole sets of 64-bit hashes. Nodes without a link have no label.
    """

    def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, size, one, two = [], [], [], []
            for t in batch.column("text").to_pylist():
                h = np.unique(shingle_hashes(t, width))
                fps.append(skewed_fingerprints(h) if len(h) else np.zeros(0, np.int64))
                size.append(len(h))
                a, b = _set_keys(h)
                one.append(a)
                two.append(b)
            ends = np.concatenate([[0], np.cumsum([len(f) for f in fps])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *fps]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, flat), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["id", "fps", "size", "k1", "k2"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, held = [], []
            for n, (t, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2")), strict=True)):
                h = np.unique(shingle_hashes(t, width))
                if _set_keys(h) == (a, b):  # rows that share an id may differ
                    kept.append(n)
                    held.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(kept, pa.int64())), pa.array(held, pa.binary())], ["node", "set"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):  # without copies of the sets
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = base.schema["id"].dataType.simpleString()
    marks = written(base.mapInArrow(marks_of, f"id {kind}, fps array<long>, size int, k1 long, k2 long").filter("size > 0"))
    sets = marks.groupBy("k1", "k2").agg(F.first("fps").alias("fps"), F.first("size").alias("size"), F.min("id").alias("id"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()))
    placed = written(marks.select("id", "k1", "k2").join(sets.select("k1", "k2", "node"), ["k1", "k2"]).select("id", "node"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("node").to_pylist(), batch.column("set"), strict=True):
                h = np.frombuffer(x.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i, np.int64)), pa.array(h)], ["node", "h"])

    def rows_of(some: DataFrame, labels: DataFrame | None) -> DataFrame:
        more = [c for c in some.columns if c not in sets.columns and c not in ITEM]
        items = some.select(F.col("node").alias("id"), "size", "common", F.col("open") if "open" in some.columns else F.lit(True).alias("open"), *more, F.posexplode("fps").alias("table", "fp"))
        if labels is None:
            items = items.withColumn("comp", F.col("id"))
        else:
            items = items.join(labels.toDF("id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        return trie_rows(items, SKEWED_BITS, SKEWED_BUDGET)

    def pairs_of(rows: DataFrame, **how) -> DataFrame:
        pairs = trie_join(written(rows), SKEWED_BITS, SKEWED_BUDGET, similarity=similarity, **how)
        return written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def tried(rows: DataFrame) -> DataFrame:
        """(b, a): for each item that is open the one that most of its links in the trie are to."""
        links = trie_join(written(rows), SKEWED_BITS, SKEWED_BUDGET, thin=stars, similarity=similarity).groupBy("a", "b").agg(F.count("*").alias("n"))
        return written(links.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")))

    def sets_for(pairs: DataFrame) -> DataFrame:
        some = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        some = sets.select("node", "id", "k1", "k2").join(some, "node", "left_semi")
        texts = base.join(some, "id").select("node", "k1", "k2", "text")
        return written(texts.mapInArrow(sets_of, "node long, set binary").dropDuplicates(["node"]))

    def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
        both = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
        return written(both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"))

    def joined(more: DataFrame, labels: DataFrame) -> DataFrame:
        # The components found so far, as stars, stand for the links that made them.
        return connected_components(more.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))

    # Rows that share an id are one document, even if their texts differ.
    one = placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("m")).filter("a <> m").select("id", "a")
    same = placed.join(one, "id").filter("a <> node").select("a", F.col("node").alias("b"))
    every = sets.withColumn("common", F.col("size"))
    pairs = pairs_of(rows_of(every, None).filter(F.col("turn") % (SKEWED_BUDGET + 1) == 0), thin=stars, apart=False)
    labels = connected_components(verified(pairs, sets_for(pairs)).union(same))
    # By tables, so that an item that has found a link looks for no other; it can still be another's.
    found = None
    for tables in SEARCHED:
        done = None if found is None else found.select(F.col("b").alias("node"), F.lit(False).alias("open"))
        some = every if done is None else every.join(done, "node", "left").withColumn("open", F.coalesce("open", F.lit(True)))
        new = tried(rows_of(some, labels).filter((F.col("turn") / (SKEWED_BUDGET + 1)).cast("int").isin(*tables)))
        found = new if found is None else found.union(new)
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if pairs.isEmpty():
        return placed, labels
    held = sets_for(pairs)
    labels = joined(verified(pairs, held), labels)
    # Counts are combined before the shuffle, so that a frequent shingle does no harm.
    alone = held.mapInArrow(shingles, "node long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    alone = alone.filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    some = sets.join(held.select("node"), "node", "left_semi").join(alone, "node", "left")
    some = some.withColumn("common", (F.col("size") - F.coalesce("own", F.lit(0))).cast("int"))
    some = written(some.filter(F.col("common") >= similarity * F.col("size") - 1e-6).drop("own"))
    linked = labels.select("node", F.lit(False).alias("open"))
    looking = some.join(linked, "node", "left").withColumn("open", F.coalesce("open", F.lit(True)))
    labels = joined(verified(pairs_of(rows_of(looking, labels), thin=stars), held), labels)
    far = farthest(TABLES * SKEWED_BITS, (1 - similarity) / 2)
    pairs = pairs_of(rows_of(some.select("*", *[F.get("fps", F.lit(k)).alias(f"f{k}") for k in range(TABLES)]), labels), far=far)
    return placed, joined(verified(pairs, held), labels)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` without near duplicates: of each component of similar texts the row with the smallest id stays.

    Similar are texts whose sets of `width`-word shingles have a Jaccard similarity of `similarity` or more; A-Z count as
    a-z. Rows without an id and texts without words, null ones too, take no part and stay. Rows that share an id are one
    document, and stay or go together. Very long texts are read whole, as sets of all their shingles. Ids may be of any
    type that has an order. An empty table gives an empty result; the columns are those of `docs`, whatever their names.
    """
    base = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    name = spare(docs, "gone")
    with scratch(docs.sparkSession) as keep:
        placed, labels = similar_sets(base, width, similarity)
        found = written(placed.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("comp")))
        least = found.groupBy("comp").agg(F.min("id").alias("least"))
        gone = keep(found.join(least, "comp").filter("id <> least").select(F.col("id").alias(name)).distinct())
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(f"`{name}`"), "left_anti")
