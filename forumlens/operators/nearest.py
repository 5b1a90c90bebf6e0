"""Filtered nearest neighbours by cosine over an index of cells that covers every row.

Cells are fitted on a bounded sample; every row then goes to its nearest cell, with a byte a dimension as its code. A query
looks into the cells nearest to it. Filters hold before anything is ranked; of what passes, the codes give each query its
candidates, and these are ranked anew by their whole vectors. How many cells are looked into is measured on the sample when
the index is built. A query for which these leave fewer rows than it asks for looks into all cells, so that a filter that
few rows pass loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.session import saved

#: Rows that cells are fitted on, and rows of these that the number of cells to look into is measured with.
SAMPLE, MEASURED = 10_000, 300
#: Share of the sample's true neighbours whose cells are looked into.
COVERED = 0.97
#: Bounds: cells of an index, and queries of a call, which are sent to all workers.
MAX_CELLS, MAX_QUERIES = 4_096, 4_096
#: Folders of the index, and files that a folder's rows are dealt over.
BUCKETS, SPLITS = 16, 4
ROUNDS = 12


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without a direction become zero."""
    m = np.nan_to_num(np.asarray(m, np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), 1e-300)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_cells(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centres of `cells` cells of unit rows: k-means by cosine. A centre that loses its rows takes the worst placed row."""
    rnd = np.random.default_rng(seed)
    centres = sample[rnd.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        near = sample @ centres.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        lost = np.flatnonzero(np.bincount(at, minlength=cells) == 0)
        sums[lost] = sample[np.argsort(near.max(axis=1))[: len(lost)]]
        centres = unit(sums)
    return centres


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int = 10) -> int:
    """So many cells hold COVERED of the k nearest rows of the sample's first rows, each looking into its nearest cells."""
    asked = sample[:MEASURED]
    order = np.argsort(-(asked @ centres.T), axis=1)
    place = np.argsort(order, axis=1)  # place of each cell for each query
    at = (sample @ centres.T).argmax(axis=1)
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -2.0
    best = np.argsort(-near, axis=1)[:, : min(k, len(sample) - 1)]
    needed = np.take_along_axis(place, at[best], axis=1) + 1
    return int(np.ceil(np.quantile(needed, COVERED))) if needed.size else 1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of `dim` numbers as rows; null elements are no numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


class VectorIndex:
    """An index below `path`: rows (id, cell, about, code, vector) in folders by bucket of the cell, centres, and its measures."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        meta = spark.read.parquet(f"{self.path}/meta").first()
        self.dim, self.probes, self.buckets, self.kinds = meta.dim, meta.probes, meta.buckets, meta.kinds
        self.centres = np.array([list(c) for c in meta.centres]).reshape(-1, self.dim)

    @staticmethod
    def build(df: DataFrame, id_col: str, vector_col: str, path: str, facets: dict[str, str] | None = None, cells: int | None = None, sample: int = SAMPLE, buckets: int = BUCKETS, splits: int = SPLITS) -> VectorIndex:
        """Indexes every row that has an id and a vector of the first sampled row's length; others can be no one's neighbour.

        The sample are the rows of smallest hash of the id: as many of a third of the table as of all of it.
        """
        spark, path = df.sparkSession, path.rstrip("/")
        about = F.struct(F.lit(True).alias("given"), *[F.col(f"`{c}`").alias(f) for f, c in (facets or {}).items()]).alias("about")
        rows = df.select(F.col(f"`{id_col}`").alias("id"), about, F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter("id is not null and size(vector) > 0")
        drawn = rows.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
        dim = len(drawn[0].vector) if drawn else 1
        taken = unit(np.array([[np.nan if x is None else x for x in r.vector] for r in drawn if len(r.vector) == dim]).reshape(-1, dim))
        count = min(cells or max(1, int(len(taken) ** 0.5)), MAX_CELLS, max(1, len(taken)))
        centres = fit_cells(taken, count) if len(taken) else np.zeros((1, dim))
        probes = min(probes_needed(taken, centres), len(centres)) if len(taken) > 1 else 1

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = unit(_matrix(b.column("vector"), dim))
                codes = np.rint(m * 127).astype(np.int8)
                cell = pa.array((m @ centres.T).argmax(axis=1).astype(np.int32)) if len(m) else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, cell, pa.array([c.tobytes() for c in codes], pa.binary())], [*b.schema.names, "cell", "code"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        placed_kinds = f"{kinds}, cell int, code binary, bucket int"
        placed = rows.filter(F.size("vector") == dim).mapInArrow(place, f"{kinds}, cell int, code binary").withColumn("bucket", F.col("cell") % buckets)
        dealt = placed.repartition(buckets * splits, "bucket", F.pmod(F.xxhash64("id"), F.lit(splits)))
        dealt.sortWithinPartitions("bucket", "cell").write.partitionBy("bucket").parquet(f"{path}/rows")
        meta = pa.table({"dim": [dim], "probes": [probes], "buckets": [buckets], "kinds": [placed_kinds], "centres": pa.array([centres.tolist()], pa.list_(pa.list_(pa.float64())))})
        spark.createDataFrame(meta).write.parquet(f"{path}/meta")
        return VectorIndex(spark, path)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        out = self.spark.read.schema(self.kinds).parquet(f"{self.path}/rows")
        return out if cells is None else out.filter(F.col("bucket").isin(sorted({c % self.buckets for c in cells})) & F.col("cell").isin(cells))

    def _candidates(self, asked: np.ndarray, probes: int, most: int, where: Column | None) -> DataFrame:
        """(query, id), at most `most` a query: the best by code in the query's cells, of the rows that `where` holds for."""
        order = np.argsort(-(asked @ self.centres.T), axis=1)[:, :probes]
        wanted: dict[int, np.ndarray] = {int(c): np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order)}
        dim, inside = self.dim, self.rows(None if probes >= len(self.centres) else sorted(wanted))
        inside = (inside if where is None else inside.filter(where)).select("id", "cell", "code")
        codes = (asked * 127).astype(np.float32)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[int, tuple[np.ndarray, pa.Array]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                m = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
                cell = b.column("cell").to_numpy()
                for c in np.unique(cell):
                    at = np.flatnonzero(cell == c)
                    near = codes[wanted[int(c)]] @ m[at].T
                    for q, s in zip(wanted[int(c)], near, strict=True):
                        top = np.argsort(-s)[:most]
                        ids = b.column("id").take(pa.array(at[top]))
                        old = kept.get(int(q))
                        s = s[top] if old is None else np.concatenate((old[0], s[top]))
                        ids = ids if old is None else pa.concat_arrays([old[1], ids])
                        top = np.argsort(-s, kind="stable")[:most]
                        kept[int(q)] = (s[top], ids.take(pa.array(top)))
            for q, (s, ids) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), q, np.int32)), ids, pa.array(s.astype(np.float64))], ["query", "id", "near"])

        kind = inside.schema["id"].dataType.simpleString()
        found = inside.mapInArrow(score, f"query int, id {kind}, near double")
        order_by = Window.partitionBy("query").orderBy(F.desc("near"), "id")
        return found.withColumn("n", F.row_number().over(order_by)).filter(F.col("n") <= most).select("query", "id")

    def nearest(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """(query, id, rank, score): for each of `queries` (query, vector) its k nearest rows of those that `where` holds for.

        where: a condition on the facets, as columns of the struct `about`. candidates: rows a query that are ranked by
        whole vectors, max(50, 4k) by default. Ties go to the smaller id; a vector without a direction scores 0.
        """
        most, probes = candidates or max(50, 4 * k), min(probes or self.probes, len(self.centres))
        asked = queries.select("query", F.col("vector").cast("array<double>").alias("vector")).filter(F.size("vector") == self.dim).limit(MAX_QUERIES + 1).collect()
        if len(asked) > MAX_QUERIES:
            raise ValueError(f"at most {MAX_QUERIES} queries can be asked at once")
        # The vectors of at most MAX_QUERIES queries.
        table = self.spark.createDataFrame([(n, r.query, list(r.vector)) for n, r in enumerate(asked)], f"n int, query {queries.schema['query'].dataType.simpleString()}, wanted array<double>")
        m = unit(np.array([[np.nan if x is None else x for x in r.vector] for r in asked]).reshape(-1, self.dim))
        out = saved(self._ranked(m, table, k, where, probes, most))
        if probes < len(self.centres):
            full = {r.query for r in out.groupBy("query").count().filter(F.col("count") >= k).collect()}
            short = [n for n, r in enumerate(asked) if r.query not in full]
            if short:
                again = table.filter(F.col("n").isin(short))
                more = self._ranked(np.where(np.isin(np.arange(len(m)), short)[:, None], m, 0.0), again, k, where, len(self.centres), most)
                out = out.join(again.select("query"), "query", "left_anti").select(more.columns).union(more)
        return out

    def _ranked(self, m: np.ndarray, table: DataFrame, k: int, where: Column | None, probes: int, most: int) -> DataFrame:
        found = self._candidates(m, probes, most, where).withColumnRenamed("query", "n")
        # At most `most` rows for each of at most MAX_QUERIES queries.
        both = F.broadcast(found.join(F.broadcast(table), "n")).join(self.rows().select("id", "vector"), "id")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        cosine = F.try_divide(dot("vector", "wanted"), F.sqrt(dot("vector", "vector")) * F.sqrt(dot("wanted", "wanted")))
        scored = both.select("query", "id", F.round(F.coalesce(F.nanvl(cosine, F.lit(0.0)), F.lit(0.0)), 6).alias("score"))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "id", "rank", "score")
