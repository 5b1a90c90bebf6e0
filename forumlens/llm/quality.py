"""Quality classifier: a weak-label model and a hashed linear scorer trained on its posteriors.

Overlapping heuristic labellers vote bad, good or nothing on each document. Expectation-maximisation on the counts of vote
patterns, taken over all documents, estimates how each labeller votes on bad and on good documents; the posterior of a
pattern is the soft label of its documents. The scorer is a logistic regression over hashed words, word starts and shape
features. It is fitted to the posteriors of a bounded sample of all rows, and its score decides. There are two heads: junk
and toxicity. Junk is of two kinds, noise and repetition, whose labellers tell nothing of the other kind, so that each kind
has a model of its own.

Human labels never vote and are no target. Two of the three toxicity labellers look for word starts that tell of toxic
documents, each mined from one fold of a bounded sample of labelled rows (see keywords); rows of the last fold are used for
nothing, so that accuracy can be measured on them.

Shares of distinct words and numbers of distinct features depend on the length of a text. Long texts are therefore cut
into windows of about WINDOW characters, which cover them whole. Shapes are averaged over them, and so is the junk score;
the toxic score is that of the most toxic window. What repeats from window to window is measured on the whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.llm.shared import scratch, spare, text_or_empty, written

BAD, GOOD, NONE = "b", "g", "-"
#: Rows of the sample that the scorer is fitted to, and labelled rows of a fold that keywords are mined from, at most.
SAMPLE, MINED = 6000, 3000
#: Folds of the labelled rows by a hash of the id: 0 and 1 are mined from, 2 is held out.
FOLDS = 3
#: A word start is a keyword if this many toxic rows hold it and toxic rows hold it so many deviations too often.
KEY_ROWS, KEY_Z, KEY_SIZES = 4, 6.0, (4, 5, 6, 7)
#: Share of keywords among a window's words from which it is taken for toxic, and up to which for clean.
KEY_BAD, KEY_GOOD = 0.006, 0.002
#: Characters of a window; a text of up to one and a half is one window.
WINDOW = 8000
#: Words of a run that ordinary prose of any length does not repeat.
RUN = 8
#: A feature takes part if this many rows hold it and its share of bad rows is this many deviations too high.
LEAST_ROWS, LEAST_Z = 4, 4.0
#: Slices that the features of the sample are counted in.
SLICES = 8
#: What the belief that a lone labeller is right counts, as a share of its votes.
BELIEF = 0.03
#: Rejected from this score on.
THRESHOLD = 0.5
WORD = re.compile(r"\w+")
#: ASCII to words: letters in lower case, all that is no word character to spaces.
ASCII = bytes(ord(chr(c).lower()) if c < 128 and WORD.match(chr(c)) else 32 for c in range(256))
SYMBOLS = "#$%&*|~^=<>{}[]\\@+_"
MARKS = re.compile(f"[{re.escape(SYMBOLS)}]")
BREAKS = tuple(map(re.compile, ("\n", r"\s", r"\W")))
#: Common English insults of the toxicity labellers.
INSULTS = frozenset("clown disgusting dumb idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split())

#: Words by which a text is taken to be English.
ENGLISH = frozenset(("the", "of", "and", "to", "is", "with"))


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; the pattern is for text beyond ASCII, which it takes several times as long for."""
    return text.encode().translate(ASCII).decode().split() if text.isascii() else WORD.findall(text.lower())


def shape(text: str, n_words: int, distinct: int) -> dict[str, float]:
    """Shares that tell prose from junk, each 0 to 1. n_words, distinct: words of the text, and different ones."""
    runs = text.split()
    n = len(runs)
    if not n:
        return {}
    counts = Counter(runs)
    lines = [x for x in text.split("\n") if x.strip()] if "\n" in text else [text]
    symbols = sum(map(text.count, SYMBOLS))
    return {
        "symbols": symbols / len(text),
        "marked": sum(c for r, c in counts.items() if MARKS.search(r)) / n if symbols else 0.0,
        "bare": sum(c for r, c in counts.items() if len(r) < 4 and not r.isalnum() and not any(map(str.isalnum, r))) / n,
        "repeats": 1 - len(set(pairwise(runs))) / (n - 1) if n > 1 else 0.0,
        "same": 1 - distinct / n_words if n_words else 1.0,
        "lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }


def windows(text: str) -> list[str]:
    """The text in parts of about equal length, cut after a line, a white space or a word where there is one."""
    n = max(1, round(len(text) / WINDOW - 1e-9))
    cuts = [0]
    for k in range(1, n):
        at = max(cuts[-1], len(text) * k // n)
        ends = (p.search(text, at, at + WINDOW // 20) for p in BREAKS)
        cuts.append(next((m.end() for m in ends if m), at))
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def repeated_runs(words: list[str]) -> float:
    """The share of runs of RUN words that came before."""
    if len(words) <= RUN:
        return 0.0
    numbers: dict[str, int] = {}
    w = np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.uint64, len(words))
    h = np.zeros(len(w) - RUN + 1, np.uint64)
    for k in range(RUN):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - RUN + 1 + k]
    return 1 - len(np.unique(h)) / len(h)


def _by(share: float, bad: float, good: float) -> str:
    return BAD if share >= bad else GOOD if share <= good else NONE


#: A window: how often each word stands in it, how many words, its shape.
Part = tuple[Counter[str], int, dict[str, float]]


def parse(text: str) -> list[Part]:
    """The windows of a text. Those of white space are left out."""
    parts, all_words = [], []
    for part in windows(text):
        words = words_of(part)
        counts = Counter(words)
        if s := shape(part, len(words), len(counts)):
            parts.append((counts, len(words), s))
            all_words.append(words)
    if len(parts) > 1:
        again = repeated_runs(list(chain.from_iterable(all_words)))
        for *_, s in parts:
            s["repeats"] = max(s["repeats"], again)
    return parts


Keywords = tuple[frozenset[str], ...]


class KeyMarks:
    """In which of the keyword sets one of a word's starts is, as bits. Few words share even their first letters with a keyword."""

    def __init__(self, keys: Keywords):
        self.keys, self.starts = keys, {}
        for n, some in enumerate(keys):
            for start in some:
                self.starts[start] = self.starts.get(start, 0) | 1 << n
        self.least = min(KEY_SIZES)
        self.heads = {start[: self.least] for start in self.starts}

    def of(self, word: str) -> int:
        out = 0
        for k in KEY_SIZES:
            out |= self.starts.get(word[:k], 0)
        return out

    def shares(self, counts: Counter[str], n: int) -> list[float]:
        """For each set the share of the `n` words that begin with a keyword, if two at least do."""
        heads, least = self.heads, self.least
        marks = [(self.of(w), counts[w]) for w in counts if w[:least] in heads]
        found = [sum(c for m, c in marks if m >> k & 1) for k in range(len(self.keys))]
        return [c / n if c > 1 else 0.0 for c in found]


def votes(text: str, parsed: list[Part], marks: KeyMarks | None = None) -> dict[str, str]:
    """The votes of the labellers of each fault, one letter a labeller. An empty text gets none."""
    s = {name: sum(x[name] for *_, x in parsed) / len(parsed) for name in parsed[0][2]} if parsed else {}
    n = sum(size for _, size, _ in parsed)
    times = lambda known: sum(counts[w] for counts, *_ in parsed for w in known if w in counts)
    noise = again = NONE * 3
    if s:
        noise = (_by(s["symbols"], 0.05, 0.01) if n >= 5 else NONE) + (_by(s["marked"], 0.3, 0.1) if n >= 5 else NONE) + (_by(s["bare"], 0.1, 0.01) if n >= 20 else NONE)
        lines = _by(s["lines"], 0.5, 0.25) if text.count("\n") >= 2 else NONE
        again = (_by(s["repeats"], 0.35, 0.15) if n >= 20 else NONE) + (_by(s["same"], 0.75, 0.45) if n >= 50 else NONE) + lines
    # The list is English: it says nothing on a text in another language that holds none of it.
    english = n >= 20 and times(ENGLISH) >= 0.05 * n
    toxic = BAD if times(INSULTS) else GOOD if english else NONE
    keys = () if marks is None else marks.keys
    worst = [max(x) for x in zip(*(marks.shares(counts, size) for counts, size, _ in parsed))] if keys and parsed else [0.0] * len(keys)
    for k, share in zip(keys, worst, strict=True):
        toxic += NONE if not k or n < 10 else _by(share, KEY_BAD, KEY_GOOD)
    return {"noise": noise, "again": again, "toxic": toxic + NONE * (FOLDS - 1 - len(keys))}


def _number(name: str, crc: int = 0) -> int:
    """A signed 32-bit hash: so wide that the words of a long text hit no other's feature. crc: of what stands before."""
    return (zlib.crc32(name.encode(), crc) ^ 1 << 31) - (1 << 31)


class Starts(dict):
    """word start -> its feature, by the CRC of what names the kind of feature."""

    def __init__(self, kind: str):
        super().__init__()
        self.crc = zlib.crc32(kind.encode())

    def __missing__(self, start: str) -> int:
        if len(self) > 100_000:
            self.clear()
        out = self[start] = _number(start, self.crc)
        return out


class Hasher(dict):
    """word -> its features, kept for a worker's life and cleared when it grows; starts are fewer than words and kept apart."""

    def __init__(self):
        super().__init__()
        self.whole, self.four, self.five = zlib.crc32(b"w "), Starts("4 "), Starts("5 ")

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        number = (zlib.crc32(word.encode(), self.whole) ^ 2147483648) - 2147483648
        out = self[word] = (number, self.four[word[:4]], self.five[word[:5]]) if len(word) > 4 else (number,)
        return out


@cache
def _reached(name: str, tenths: int) -> tuple[int, ...]:
    # One feature for each tenth that is reached, so that weights add up along the scale.
    return tuple(_number(f"s {name} {k}") for k in range(1, tenths + 1))


def features(part: Part, hasher: Hasher) -> np.ndarray:
    """Distinct hashed features of a window."""
    counts, _, shares = part
    found = set(chain.from_iterable(map(hasher.__getitem__, counts)))
    for name, share in shares.items():
        found.update(_reached(name, int(share * 20)))
    return np.fromiter(found, np.int32, len(found))


class Chosen:
    """Those of a window's features() that a model has weights for. Nothing is kept of words, as most have none."""

    def __init__(self, numbers: Iterable[int]):
        self.numbers = frozenset(numbers)
        self.crcs = frozenset(n % (1 << 32) for n in self.numbers)  # a feature's number is its CRC with a sign
        self.kinds = [zlib.crc32(kind) for kind in (b"w ", b"4 ", b"5 ")]

    def features(self, part: Part) -> np.ndarray:
        counts, _, shares = part
        long = [w for w in counts if len(w) > 4]
        found: set[int] = set()
        for words, kind in zip((counts, {w[:4] for w in long}, {w[:5] for w in long}), self.kinds, strict=True):
            found |= self.crcs.intersection(map(zlib.crc32, map(str.encode, words), repeat(kind)))
        found.update(n % (1 << 32) for name, share in shares.items() for n in _reached(name, int(share * 20)) if n in self.numbers)
        return np.sort(np.fromiter(found, np.uint32, len(found)).view(np.int32))


def posteriors(counts: dict[str, float], rounds: int = 100) -> tuple[dict[str, float], float, list[dict]]:
    """For each pattern the probability of bad; the share of bad; how often each labeller's votes are bad, by class.

    Starts from the votes: a pattern with a bad vote that not too many good ones speak against. Then fits for each
    labeller and class, with a small prior, how often its votes are bad. A missing vote is no evidence.
    """
    if not counts:
        return {}, 0.5, []
    patterns = list(counts)
    n = np.asarray([counts[p] for p in patterns], float)
    bad, good = (np.asarray([[v == x for v in p] for p in patterns], float) for x in (BAD, GOOD))
    cast = n @ (bad + good)
    # A lone labeller can't be told from its error, and is believed; of several, the votes tell.
    belief, right, wrong = (2 + BELIEF * cast, 0.9, 0.02) if (cast > 0).sum() < 2 else (2, 0.5, 0.5)
    post = np.where(bad.sum(1) - 0.4 * good.sum(1) > 0, 0.9, 0.05)
    rates: list[dict] = []
    for _ in range(rounds):
        share = (n @ post + 1) / (n.sum() + 2)
        # How often a vote on a document of the class is bad: of labellers that vote at random, as often in both.
        on_bad = ((n * post) @ bad + belief * right) / ((n * post) @ (bad + good) + belief)
        on_good = ((n * (1 - post)) @ bad + belief * wrong) / ((n * (1 - post)) @ (bad + good) + belief)
        rates = [{"bad": float(x), "good": float(y)} for x, y in zip(on_bad, on_good, strict=True)]
        logit = np.log(share / (1 - share)) + bad @ np.log(on_bad / on_good) + good @ np.log((1 - on_bad) / (1 - on_good))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return dict(zip(patterns, map(float, post), strict=True)), float(share), rates


def _at(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The places in `known`, which is sorted, of those that it holds."""
    at = np.searchsorted(known, found)
    at[at == len(known)] = 0
    return at[known[at] == found] if len(known) else at[:0]


def fit_linear(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray | None = None, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted feature numbers, weights, bias) of a logistic regression on the features that tell of bad rows.

    Weights are not negative: a document is rejected for what it holds, and never for what it lacks, as short ones do.
    `weight`: what each row counts, 1 by default.
    """
    weight = np.ones(len(rows)) if weight is None else weight
    share = float(np.clip(np.average(target, weights=weight), 1e-3, 1 - 1e-3)) if len(target) else 0.01
    bias = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int32), np.zeros(0), bias
    if not len(rows):
        return none
    # Features are counted a slice after the other, and their sums made row by row, as the driver has little memory.
    found = []
    for k in range(SLICES):
        names, n = np.unique(np.concatenate([r[r % SLICES == k] for r in rows]), return_counts=True)
        found.append(names[n >= LEAST_ROWS])
    names = np.sort(np.concatenate(found))
    held, bad = np.zeros(len(names)), np.zeros(len(names))
    for r, w, t in zip(rows, weight, target, strict=True):
        at = _at(names, r)
        held[at] += w
        bad[at] += w * t
    z = (bad - held * share) / np.sqrt(np.maximum(held, 1) * share * (1 - share))
    chosen = np.nonzero((held >= LEAST_ROWS) & (z >= LEAST_Z))[0]
    if not len(chosen):
        return none
    names = names[chosen]
    places = [np.sort(_at(names, r)) for r in rows]
    of, cols = np.repeat(np.arange(len(rows)), [len(p) for p in places]), np.concatenate(places)
    w, m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    w[-1] = bias
    for t in range(1, rounds + 1):
        err = 1 / (1 + np.exp(-(np.bincount(of, w[cols], minlength=len(rows)) + w[-1]))) - target
        err *= weight
        g = np.append(np.bincount(cols, err[of], minlength=len(chosen)), err.sum()) / weight.sum()
        g[:-1] += 1e-4 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return names, w[:-1], float(w[-1])


#: Faults have labellers of their own, and each head tells of one or more faults.
FAULTS = ("noise", "again", "toxic")
HEADS = {"junk": ("noise", "again"), "toxic": ("toxic",)}
VOTES = T.StructType([T.StructField(f, T.StringType()) for f in FAULTS])


def fold_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(f"`{id_col}`", F.lit("fold")), F.lit(FOLDS)).cast("int")


def _share(cols: list[str], most: int, n: int) -> Column:
    """Holds for at most `most` of `n` rows in expectation, by a hash of the columns."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cols]), F.lit(1 << 30)) < int((1 << 30) * min(1, most / max(n, 1)))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, start, n, bad) of (t, toxic, fold): rows that hold a word start, and toxic ones of these; the empty start is in all."""
    for batch in batches:
        total, bad = Counter(), Counter()
        for t, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("t", "toxic", "fold")), strict=True):
            # Starts of each text once: what tells of a toxic row is no matter of its length.
            starts = {(fold, w[:k]) for w in set(words_of(t)) for k in KEY_SIZES if len(w) >= k} | {(fold, "")}
            total.update(starts)
            if toxic > 0:
                bad.update(starts)
        folds, starts = zip(*total, strict=True) if total else ((), ())
        yield pa.RecordBatch.from_pydict({"fold": pa.array(folds, pa.int32()), "start": pa.array(starts, pa.string()), "n": pa.array(total.values(), pa.int64()), "bad": pa.array([bad[k] for k in total], pa.int64())})


def keywords(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MINED) -> Keywords:
    """The keywords of the folds that are mined, each from at most `most` labelled rows; none without toxic ones.

    Keywords are word starts by which a fold's toxic rows are told from its others. They are counted where the texts are, and
    only they come to the driver. Null labels are none; of repeated rows the worst counts.
    """
    one = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic"), fold_of("doc_id").alias("fold")).filter(F.col("fold") < FOLDS - 1)
    n = dict(one.groupBy("fold").count().collect())
    some = one.filter(F.greatest(*[F.when(F.col("fold") == k, _share(["i"], most, n.get(k, 0))).otherwise(False) for k in range(FOLDS - 1)]))
    # A bounded number of rows, so fit to be broadcast.
    joined = docs.select(F.col(f"`{id_col}`").alias("i"), text_or_empty(text_col).alias("t")).join(F.broadcast(some), "i").select("t", "toxic", "fold")
    counted = joined.mapInArrow(_starts, "fold int, start string, n long, bad long").groupBy("fold", "start").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    with scratch(docs.sparkSession):
        counted = written(counted)
        shares = {r.fold: r.bad / r.n for r in counted.filter("start = ''").collect()}
        found: list[set[str]] = [set() for _ in range(FOLDS - 1)]
        for fold, share in shares.items():
            if 0 < share < 1:
                z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
                told = counted.filter((F.col("fold") == fold) & (F.col("start") != "") & (F.col("bad") >= KEY_ROWS) & (F.col("bad") >= 0.4 * F.col("n")) & (z >= KEY_Z))
                found[fold] = {r.start for r in told.select("start").collect()}
    return tuple(map(frozenset, found))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model: for each head (feature numbers, weights, bias); keywords; what each fault's labellers are worth.

    A text is junk if it has one of the faults of that head, so that their posteriors are combined.

    The scorer's rows are `sample` of all rows at most, chosen by a hash of id and text, so
    that rows without an id, or with one id, are chosen like others; each counts as one, in parts.
    """
    keys = keywords(docs, labels, id_col, text_col)
    known = docs.sparkSession.sparkContext.broadcast(keys)
    base = docs.select(F.col(f"`{id_col}`").alias("i"), text_or_empty(text_col).alias("t"))

    @F.pandas_udf(VOTES)
    def votes_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        marks = KeyMarks(known.value)
        for batch in texts:
            yield pd.DataFrame([votes(t, parse(t), marks) for t in batch], columns=list(FAULTS))

    @F.pandas_udf(T.StructType([*VOTES.fields, T.StructField("f", T.ArrayType(T.BinaryType()))]))
    def votes_and_features_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hasher, marks = Hasher(), KeyMarks(known.value)
        for batch in texts:
            rows = []
            for t in batch:
                parsed = parse(t)
                v = votes(t, parsed, marks)
                rows.append((*(v[f] for f in FAULTS), [features(part, hasher).tobytes() for part in parsed]))
            yield pd.DataFrame(rows, columns=[*FAULTS, "f"])

    # At most 3 ** 9 patterns, whatever the corpus.
    counts = base.select(votes_of("t").alias("v")).select("v.*").groupBy(*FAULTS).agg(F.count("*").alias("n")).collect()
    some = base.filter(_share(["i", "t"], sample, sum(r.n for r in counts))).limit(2 * sample)
    some = some.select(votes_and_features_of("t").alias("v")).select("v.*").toPandas()
    parts = [len(f) for f in some["f"]]
    weight = np.repeat(1 / np.maximum(parts, 1), parts)
    rows = [np.frombuffer(x, np.int32) for f in some["f"] for x in f]
    model: dict = {"keywords": keys, "faults": {}}
    for fault in FAULTS:
        by_pattern: Counter = Counter()
        for r in counts:
            by_pattern[r[fault]] += r.n
        post, share, rates = posteriors(by_pattern)
        model["faults"][fault] = {"posteriors": post, "share": share, "labellers": rates}
    for head, faults in HEADS.items():
        clean = [1 - np.asarray([model["faults"][f]["posteriors"][p] for p in some[f]], float) for f in faults]
        model[head] = fit_linear(rows, np.repeat(1 - np.prod(clean, axis=0), parts), weight)
    return model


OUT = ("quality_votes", "junk_score", "toxic_score", "quality_kept")


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` plus quality_votes, junk_score, toxic_score (0 to 1) and quality_kept."""
    held = docs.sparkSession.sparkContext.broadcast((*[model[h] for h in HEADS], model["keywords"]))

    @F.pandas_udf("struct<votes:string,junk:double,toxic:double>")
    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        junk, toxic, keys = held.value
        # Of the other features no weight is looked up.
        chosen = Chosen(chain(junk[0].tolist(), toxic[0].tolist()))
        marks = KeyMarks(keys)
        total = lambda head, f: head[1][_at(head[0], f)].sum() + head[2]
        for batch in texts:
            rows = []
            for t in batch:
                parsed = parse(t)
                fs, v = [chosen.features(part) for part in parsed] or [np.zeros(0, np.int32)], votes(t, parsed, marks)
                z = sum(total(junk, f) for f in fs) / len(fs), max(total(toxic, f) for f in fs)
                rows.append(("/".join(v.values()), *(1 / (1 + np.exp(-float(np.clip(x, -30, 30)))) for x in z)))
            yield pd.DataFrame(rows, columns=["votes", *HEADS])

    name = spare(docs, "judged")
    out = docs.withColumn(name, judge(text_or_empty(text_col)))
    got = F.col(f"`{name}`")
    kept = (got["junk"] < THRESHOLD) & (got["toxic"] < THRESHOLD)
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in OUT]
    return out.select(*cols, got["votes"].alias(OUT[0]), got["junk"].alias(OUT[1]), got["toxic"].alias(OUT[2]), kept.alias(OUT[3]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """fit() on `docs`, then score() of every row.

    Null texts count as empty; an empty text has no votes and no features, and is kept, as weights are not negative
    and the bias alone stays below the threshold unless most rows are bad. Very long texts are read whole, in windows.
    Without labels no keywords are mined, and the other labellers alone make the posteriors. Repeated rows are scored
    alike. Ids may be of any type that the ids of `labels` can be joined to. Of the input columns only those with the
    names of the four new ones are replaced. An empty table gives an empty result.
    """
    return score(docs, fit(docs, labels, id_col, text_col, sample), text_col)
