"""Exact top-k inner products over vectors sorted by length.

All vectors are sorted by descending length over partitions. The longest of them are tried first and give each query a
floor, its k-th best score so far. Then each task streams its vectors in blocks, longest first, against queries of a
bounded number, which are broadcast: of a block, a query is done where the product of lengths falls below its floor. The rest of a block is scored by the leading coordinates after rotation by the singular vectors of
the corpus, and only where that partial sum plus the Cauchy-Schwarz bound of the remaining coordinates reaches the floor
are the whole integer vectors multiplied. A task hands on at most k vectors a query, which are merged by query.

More queries than fit the bound take several passes; vectors that are too short for all queries of a pass are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.shared import scratch, written

#: Vectors that give the first floors, vectors of a partition, and the step in which a block is walked.
FIRST, ROWS, STEP = 4096, 1 << 13, 512
#: Queries of a pass, and bytes that their vectors take, at most.
QUERIES, QUERY_BYTES = 1 << 14, 32 << 20
#: Vectors of more components are not rotated: the sums for it go through the driver.
ROTATED = 1024
#: Vectors that the rotation is fitted on, at most in expectation, and tasks that sum them.
SPUN, SPINNERS = 1 << 18, 16
SCALE = 256.0


def quantised(vectors: DataFrame, asks: Column, id_col: str, vector_col: str) -> DataFrame:
    """(uid, id, asks, norm, vec): floor(256 * x) of each component as 64-bit floats, of valid rows."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = [np.floor(SCALE * np.asarray(v, np.float64)) for v in b.column("v").to_pylist()]
            with np.errstate(over="ignore"):
                norms = [float(np.linalg.norm(x)) for x in ints]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("asks"), pa.array(norms, pa.float64()), pa.array([x.tobytes() for x in ints], pa.binary())], ["id", "asks", "norm", "vec"])

    df = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # What is too large to be scaled is no number either.
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < float("inf")))
    found = df.filter("id is not null and v is not null").filter(fine).mapInArrow(prepare, "id long, asks boolean, norm double, vec binary")
    return found.withColumn("uid", F.monotonically_increasing_id())


def _matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(vecs), dim))
    for row, v in zip(out, vecs, strict=True):
        x = np.frombuffer(v)
        row[: len(x)] = x
    return out


def rotation(vectors: DataFrame, dim: int, n: int) -> np.ndarray:
    """The right singular vectors, strongest first, of SPUN of the `n` rows at most, from sums of dim * dim products.

    The rows are chosen by a hash and summed by SPINNERS tasks, as the rotation decides speed and never a result. Of vectors
    of over ROTATED components, no rotation.
    """
    if dim > ROTATED:
        return np.eye(dim)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column("vec").to_pylist(), dim)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            gram += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(dim * dim), pa.int64()), "x": pa.array(gram.ravel(), pa.float64())})

    some = vectors.filter(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int((1 << 30) * min(1, SPUN / max(n, 1))))
    sums = some.select("vec").repartition(min(SPINNERS, 1 + n // ROWS)).mapInArrow(products, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros(dim * dim)
    for r in sums:  # dim * dim rows
        gram[r["at"]] = r["x"]
    _, v = np.linalg.eigh(gram.reshape(dim, dim))
    return v[:, ::-1]


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: by floats where those are exact, else by whole numbers of any size."""
    if q.size and v.size and q.shape[-1] * float(np.abs(q).max()) * float(np.abs(v).max()) >= 2.0**53:
        out = np.array([[int(x) for x in row] for row in q], object) @ np.array([[int(x) for x in row] for row in v], object).T
        return np.clip(out, -(2**63), 2**63 - 1)
    return q @ v.T


def at_most(score: int) -> float:
    """A float that is not above the score."""
    return float(score) - (abs(score) * 2.0**-52 if abs(score) >= 2**53 else 0.0)


class Search:
    """The best k so far of each of some queries; blocks are tried longest first."""

    def __init__(self, q: np.ndarray, uids: np.ndarray, floors: np.ndarray, turn: np.ndarray, k: int):
        self.q, self.uids, self.floors, self.turn, self.k = q, uids, floors.astype(float).copy(), turn, k
        self.lead = max(1, q.shape[1] // 4)
        self.length = np.linalg.norm(q, axis=1)
        self.turned = self._rotate(q)
        self.best: dict[int, list[tuple[int, int, int]]] = {}

    def _rotate(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.turn
        return y[:, : self.lead], np.linalg.norm(y[:, self.lead :], axis=1)

    def reaches(self, length: float) -> bool:
        """Whether a vector of this length can reach the floor of any query."""
        return bool((self.length * length + 1e-6 * (1 + self.length * length) >= self.floors).any())

    def add(self, v: np.ndarray, ids: np.ndarray, uids: np.ndarray, lengths: np.ndarray) -> None:
        """Tries a block whose lengths descend."""
        front, rest = self._rotate(v)
        for at in range(0, len(v), STEP):
            s = slice(at, at + STEP)
            slack = 1e-6 * (1 + self.length * lengths[at])
            live = np.nonzero(self.length * lengths[at] + slack >= self.floors)[0]
            if not len(live):
                return  # what follows is no longer
            bound = self.turned[0][live] @ front[s].T + np.outer(self.turned[1][live], rest[s]) + slack[live, None]
            may = (bound >= self.floors[live, None]) & (uids[s][None, :] != self.uids[live, None])
            some = np.nonzero(may.any(1))[0]
            if not len(some):
                continue
            cols = np.nonzero(may[some].any(0))[0]
            scores = exact_products(self.q[live[some]], v[s][cols])
            for i, row in zip(some, scores, strict=True):
                n = int(live[i])
                ok = np.nonzero(may[i][cols] & (row >= self.floors[n]))[0]
                if not len(ok):
                    continue
                if len(ok) > self.k:  # only what ties with the k-th best can stay
                    ok = ok[row[ok] >= np.sort(row[ok])[-self.k]]
                new = [(int(row[j]), int(ids[s][cols[j]]), int(uids[s][cols[j]])) for j in ok]
                best = self.best[n] = sorted(self.best.get(n, []) + new, key=lambda x: (-x[0], x[1], x[2]))[: self.k]
                if len(best) == self.k:
                    self.floors[n] = max(self.floors[n], at_most(best[-1][0]))


def _columns(b: pa.RecordBatch, dim: int) -> tuple[np.ndarray, ...]:
    """The matrix, ids, uids and lengths of a batch, longest first."""
    lengths = b.column("norm").to_numpy()
    order = np.argsort(-lengths, kind="stable")
    return _matrix(b.column("vec").to_pylist(), dim)[order], b.column("id").to_numpy()[order], b.column("uid").to_numpy()[order], lengths[order]


def top_k(vectors: DataFrame, asks: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", queries: int = QUERIES, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `asks` holds, the k other rows of highest score, or all.

    The score is the inner product of the quantised vectors. Ties go to the smaller id. Vectors that are null or hold
    null or non-finite components, or finite ones that 256 times are not, take no part, nor do null ids. Rows that share an id are rows of their own: each is
    asked for and found by itself, and a row's copy is another row. Vectors of unequal dimension count as padded with
    zeros; very long ones (over ROTATED) are searched without rotation. An empty table gives an empty result. Other
    columns are not read, so that their names cannot clash.
    """
    spark = vectors.sparkSession
    with scratch(spark) as keep:
        base = written(quantised(vectors, asks, id_col, vector_col))
        n, dim = base.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0)) / 8).first()
        dim, parts = max(1, int(dim)), max(1, -(-n // rows))
        every = written(base.repartitionByRange(parts, F.desc("norm"), "uid").sortWithinPartitions(F.desc("norm")))
        turn = spark.sparkContext.broadcast(rotation(every, dim, n))  # dim * dim numbers

        # The longest vectors, of a bounded number, give the floors of all queries.
        longest = every.orderBy(F.desc("norm"), "uid").limit(max(1, min(FIRST, QUERY_BYTES // (8 * dim)))).toArrow()
        batches = longest.combine_chunks().to_batches()
        first = spark.sparkContext.broadcast(_columns(batches[0], dim) if batches else None)

        def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, _, uids, lengths = _columns(b, dim)
                order = np.argsort(-b.column("norm").to_numpy(), kind="stable")
                search = Search(q, uids, np.full(len(q), -np.inf), turn.value, k)
                if len(q):
                    search.add(*first.value)
                sorted_ = b.take(pa.array(order))
                yield pa.RecordBatch.from_arrays([sorted_.column("uid"), sorted_.column("id"), sorted_.column("norm"), sorted_.column("vec"), pa.array(search.floors)], ["uid", "id", "norm", "vec", "least"])

        some = max(1, min(queries, QUERY_BYTES // (8 * dim)))
        asked = every.filter("asks").select("uid", "id", "norm", "vec").mapInArrow(floors, "uid long, id long, norm double, vec binary, least double")
        # Queries of a pass are of like length; ordinals come from the sorted partitions.
        asked = written(asked.repartitionByRange(max(1, -(-n // rows)), F.desc("norm"), "uid").withColumn("part", F.spark_partition_id()))
        sizes = asked.groupBy("part").agg(F.count("*").alias("n"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        within = Window.partitionBy("part").orderBy(F.desc("norm"), "uid")
        asked = asked.withColumn("n", F.row_number().over(within)).join(sizes, "part")
        asked = written(asked.withColumn("pass", F.floor((F.col("before") + F.col("n") - 1) / some)).drop("part", "n", "before"))

        found = None
        for p in [r["pass"] for r in asked.select("pass").distinct().orderBy("pass").collect()]:
            own = asked.filter(F.col("pass") == p).select("uid", "id", "norm", "vec", "least").toArrow().combine_chunks().to_batches()[0]
            q, q_ids, q_uids, q_len = _columns(own, dim)
            least = own.column("least").to_numpy()[np.argsort(-own.column("norm").to_numpy(), kind="stable")]
            held = spark.sparkContext.broadcast((q, q_ids, q_uids, least))
            # Below this length no vector reaches any query's floor.
            with np.errstate(divide="ignore", invalid="ignore"):
                short = np.where(q_len > 0, (least - 1e-6) / q_len, np.where(least <= 1e-6, -np.inf, np.inf)).min()

            def walk(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                q, q_ids, q_uids, least = held.value
                search = Search(q, q_uids, least, turn.value, k)
                for b in batches:  # of several files, so that longer vectors can follow
                    if search.reaches(max(b.column("norm").to_pylist(), default=0.0)):
                        search.add(*_columns(b, dim))
                rows = [(int(q_uids[i]), int(q_ids[i]), u, v, s) for i, best in search.best.items() for s, v, u in best]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(5)], ["q", "query_id", "uid", "vec_id", "score"])

            near = every if not np.isfinite(short) or short <= 0 else every.filter(F.col("norm") >= float(short * (1 - 1e-6)))
            got = keep(near.select("uid", "id", "norm", "vec").mapInArrow(walk, "q long, query_id long, uid long, vec_id long, score long"))
            found = got if found is None else found.union(got)
            held.unpersist()
        if found is None:
            found = spark.createDataFrame([], "q long, query_id long, uid long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
