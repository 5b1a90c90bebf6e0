"""Token counts of whole texts by a map-side two-tier lookup.

Tier one is a compact table pre-token -> number of tokens of those that are frequent in the corpus, broadcast to all
workers; tier two is each worker's own cache, filled by the library. Pre-tokens are never shuffled: a first pass over all
texts keeps a summary of bounded size in each task (Misra-Gries counters), and the summaries, one row a task, are merged
in a tree. The table decides how fast a count is found and never what it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm import bpe
from forumlens.llm.shared import scratch, text_or_empty, written

#: Entries of the broadcast table: below 4 MB whatever the corpus is.
FREQUENT = 30_000
#: Counters that a task hands on.
PER_TASK = 8_000
#: Counters that a task holds before it prunes.
HELD = 400_000
#: Summaries that one task merges, at most.
MERGED = 64


def _row(counts: Counter, most: int) -> pa.RecordBatch:
    top = counts.most_common(most)
    return pa.RecordBatch.from_pydict({"pieces": pa.array([[p for p, _ in top]], pa.list_(pa.string())), "n": pa.array([[n for _, n in top]], pa.list_(pa.int64()))})


def frequent_pieces(texts: DataFrame, tokenizer_path: str, most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens of the column `text`, at most `most`; from summaries of every text."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, counts = bpe.worker_encoder(tokenizer_path, "len"), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(enc.split(text) or ())
                if len(counts) > HELD:
                    # Misra-Gries: what all counters can lose is taken from each, and empty ones go.
                    least = sorted(counts.values(), reverse=True)[HELD // 2]
                    counts = Counter({p: n - least for p, n in counts.items() if n > least})
        yield _row(Counter({p: n for p, n in counts.items() if len(p) <= bpe.KEPT}), PER_TASK)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for pieces, n in zip(batch.column("pieces").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for p, k in zip(pieces, n, strict=True):
                    counts[p] += k
        yield _row(counts, most)

    kind = "pieces array<string>, n array<long>"
    with scratch(texts.sparkSession):
        found = written(texts.select("text").mapInArrow(summary, kind))
        n = found.count()
        while n > 1:
            n = -(-n // MERGED)
            found = written(found.repartition(n).mapInArrow(merge, kind))
        one = found.first()
    return list(one.pieces) if one else []


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """All rows and columns of `docs` plus n_bytes, n_tokens and over_limit (n_tokens > limit).

    Null texts count as empty and have no bytes or tokens. Texts are taken whole, of any length; of very long ones only
    short pre-tokens are kept in a cache. Special strings in a text are treated as the library does by default. Repeated
    rows come out as often as they come in. Columns of these names in the input are replaced, whatever their case. An
    empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    head = frequent_pieces(docs.select(text.alias("text")), tokenizer_path, frequent)
    own = bpe.Encoder(tokenizer_path, len)
    table = docs.sparkSession.sparkContext.broadcast({p: len(own.piece(p)) for p in head})

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = bpe.Encoder(tokenizer_path, len, table.value)
        for batch in batches:
            yield pd.Series([enc.count(t) for t in batch], dtype="int64")

    out = docs.drop("n_bytes", "n_tokens", "over_limit")
    out = out.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": tokens(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
