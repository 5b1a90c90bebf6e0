"""Best-fit packing of tokenized documents by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so that the corpus is known to the planner by a histogram of at most
`capacity` counts, and the plan is a table of runs, whose size depends on the capacity and not on the corpus:

1. large pieces are split by length into groups of about equal cardinality and rounded up to their group's largest;
2. configurations (sets of few sizes that fit a sequence) are optimised by column generation, and rounded down;
3. actual pieces are substituted: each place gets the longest piece that its group still has, and the last place, which
   has what rounding left over besides its own, the longest large piece of any group that fits;
4. large pieces that are left, and then the small ones, go by best fit into the gaps, longest first.

Several numbers of groups are planned until a plan is close to what the tokens need, and the one of fewest sequences is
taken. Spark cuts and counts the pieces, numbers
those of each length, and finds each piece's run by its length and number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm import bpe
from forumlens.llm.shared import numbered, text_or_empty, written

#: Numbers of groups that are planned; with fewer distinct lengths, each is a group of its own.
GROUPS = (8, 16, 32, 64, 128)
#: Lengths up to these shares of the capacity count as small; each is planned with.
SMALL = (1 / 8, 3 / 8)
#: A plan is good enough if it has this share of sequences, and one, more than the tokens need, at most.
CLOSE = 1e-4
#: Pieces of a length that a task numbers, and parts that a length is dealt over at least.
PART_ROWS, LEAST_PARTS = 1 << 20, 64


@dataclass
class Run:
    """`n` sequences of the same content: (length, pieces of that length in each, number of the first)."""

    n: int
    room: int
    holds: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, n: int) -> tuple[Run, Run]:
        rest = [(size, each, first + each * n) for size, each, first in self.holds]
        return Run(n, self.room, list(self.holds)), Run(self.n - n, self.room, rest)


class Planner:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {k: n for k, n in sorted(counts.items(), reverse=True) if n}
        self.next = dict.fromkeys(self.left, 0)
        self.open: dict[int, list[Run]] = {}  # by room
        self.rooms: list[int] = []

    def put(self, run: Run) -> None:
        if run.n:
            if run.room not in self.open:
                insort(self.rooms, run.room)
            self.open.setdefault(run.room, []).append(run)

    def take(self, room: int) -> Run:
        run = self.open[room].pop()
        if not self.open[room]:
            del self.open[room]
            self.rooms.remove(room)
        return run

    def fill(self, run: Run, size: int, each: int) -> None:
        """Puts `each` pieces of `size` into each sequence of the run."""
        run.holds.append((size, each, self.next[size]))
        run.room -= size * each
        self.next[size] += each * run.n
        self.left[size] -= each * run.n
        self.put(run)

    def best_fit(self) -> None:
        """What is left goes into the fullest sequence that has room, longest first."""
        for size in self.left:
            while (n := self.left[size]) > 0:
                at = bisect_left(self.rooms, size)
                run = self.take(self.rooms[at]) if at < len(self.rooms) else Run(-(-n // (self.capacity // size)), self.capacity)
                each = min(run.room // size, n)
                full = min(run.n, n // each)
                run, rest = run.split(full)
                self.put(rest)
                self.fill(run, size, each)

    def group(self, n_groups: int, large: list[int]) -> int:
        """Packs large sizes by the scheme's configurations and says into how many sequences; the rest stays in `left`."""
        groups = grouped([(size, self.left[size]) for size in large], n_groups)
        demand = [sum(self.left[size] for size in g) for g in groups]
        there = sorted(large)  # those of which pieces are left
        done = 0

        def gone(size: int) -> bool:
            if not self.left[size]:
                there.pop(bisect_left(there, size))
            return not self.left[size]

        for pattern, times in configurations([g[0] for g in groups], demand, self.capacity):
            places = [k for k, c in enumerate(pattern) for _ in range(int(c))]
            while times:
                # One sequence, and as many more as there are pieces for.
                taken: Counter[int] = Counter()
                room = self.capacity
                for n, k in enumerate(places):
                    if n + 1 < len(places):
                        size = next((x for x in groups[k] if self.left[x] > taken[x]), None)
                    else:
                        size = next((x for x in reversed(there[: bisect_right(there, room)]) if self.left[x] > taken[x]), None)
                    if size is None:
                        break
                    taken[size] += 1
                    room -= size
                if taken.total() < len(places):
                    break
                n = min([times, *(self.left[size] // c for size, c in taken.items())])
                run = Run(n, self.capacity)
                for size, c in taken.items():
                    run.holds.append((size, c, self.next[size]))
                    run.room -= size * c
                    self.next[size] += c * n
                    self.left[size] -= c * n
                    gone(size)
                self.put(run)
                times -= n
                done += n
        return done


def grouped(counts: list[tuple[int, int]], n_groups: int) -> list[list[int]]:
    """Sizes, longest first, in groups of about equally many pieces; a size is not parted."""
    each = sum(n for _, n in counts) / max(1, n_groups)
    groups: list[list[int]] = []
    held = 0.0
    for size, n in counts:
        if not groups or held + n / 2 > each or n >= each:
            groups.append([])
            held = 0.0
        groups[-1].append(size)
        held += n
        if n >= each:
            held = each
    return groups


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used: the configuration program's optimum, rounded down.

    Column generation: the simplex method over patterns, whose next column is an unbounded knapsack for the duals.
    """
    k = len(sizes)
    need, size = np.asarray(demand, float), np.asarray(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(50 * k):
        x = np.linalg.solve(basis, need)
        duals = np.linalg.solve(basis.T, np.ones(k))
        best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            fits = size <= c
            if fits.any():
                value = np.where(fits, best[c - np.minimum(size, c)] + duals, -np.inf)
                g = int(value.argmax())
                if value[g] > best[c] + 1e-12:
                    best[c], last[c] = value[g], g
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        way = np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, np.maximum(x, 0) / np.where(way > 1e-9, way, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, need)
    return [(basis[:, j].astype(int), int(x[j] + 1e-6)) for j in range(k) if x[j] >= 1 - 1e-6]


@dataclass
class Plan:
    """groups: how many the lengths were rounded in; configured: sequences that came from configurations."""

    runs: list[Run]
    groups: int
    configured: int

    @property
    def sequences(self) -> int:
        return sum(r.n for r in self.runs)


def plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = GROUPS, small: tuple[float, ...] = SMALL) -> Plan:
    """The plan of fewest sequences for a histogram of piece lengths, of those for each of `small` and `groups`."""
    best = Plan([], 0, 0)
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    for share in small:
        for g in groups:
            p = Planner(counts, capacity)
            large = [s for s in p.left if s > share * capacity]
            done = p.group(g, large) if large else 0
            p.best_fit()
            found = Plan([r for rs in p.open.values() for r in rs], min(g, len(large)), done)
            if not best.runs or found.sequences < best.sequences:
                best = found
            if best.sequences <= least * (1 + CLOSE) + 1:
                return best
            if g >= len(large):
                break
    return best


def plan_table(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan by (length, number of the first piece): first sequence, pieces in each, offset of the first."""
    rows, first = [], 0
    for r in runs:
        at = 0
        for size, each, number in r.holds:
            rows.append((size, number, first, each, at))
            at += size * each
        first += r.n
    rows.sort()
    return {k: np.asarray([x[i] for x in rows], np.int64) for i, k in enumerate(("size", "number", "first", "each", "at"))}


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: whole ones of `capacity`, and before them what is over."""
    over = n_ids % capacity
    out = [(0, over)] if over else []
    return out + [(s, capacity) for s in range(over, n_ids, capacity)]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every document's pieces."""

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = bpe.worker_encoder(tokenizer_path, "ids"), bpe.ids_bytes([end_id])
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column("text")):
                ids = enc.ids(text.as_py()) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((i, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            of, *rest = (pa.array(c) for c in np.asarray(rows, np.int64).reshape(-1, 5).T)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), rest[0].cast(pa.int32()), *rest[1:]], ["id", "piece", "start", "length", "ids_crc32"])

    df = docs.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(cut_batches, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: the id, piece, start, length, ids_crc32, sequence_id, offset, and plan_groups.

    plan_groups: into how many groups the plan rounds large lengths. Null and empty texts are documents of the end id
    alone. Only documents longer than the capacity are cut; very long texts are read whole. Rows that repeat are packed
    as often as they come; null ids stay null, and ids may be of any type. Other columns are not read, so their names
    cannot clash. An empty table gives an empty result.
    """
    pieces = written(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    found = plan(counts, capacity)
    # Runs are at most a few for each length and configuration, whatever the corpus is.
    where = docs.sparkSession.sparkContext.broadcast(plan_table(found.runs))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        p = where.value
        size, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        i = np.searchsorted((p["size"] << 40) + p["number"], (size << 40) + number, side="right") - 1
        nth = number - p["number"][i]
        return pd.DataFrame({"sequence_id": p["first"][i] + nth // p["each"][i], "offset": p["at"][i] + nth % p["each"][i] * size})

    parts = max(LEAST_PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    part = F.pmod(F.xxhash64("id", "piece"), F.lit(parts))
    ranked = numbered(pieces, "length", part, ["id", "piece", "ids_crc32"], "number")
    out = ranked.withColumn("at", place("length", "number")).withColumn("plan_groups", F.lit(found.groups))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", "plan_groups")
