"""Mixing sources to target weights by Poisson replication.

A source's rate is its share of the target divided by its share of the corpus. Each document draws its number of
copies from the Poisson distribution of its source's rate, by inverting the distribution at a uniform number that is a
hash of the document's id and a seed: so counts need no coordination, and a lost task draws them again alike. The
copies are then sorted by a hash, which is a global shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.shared import text_or_empty, written

#: Sources up to which their rates are broadcast; with more, Spark joins them by shuffles.
FEW = 10_000
NULL = "\x00null"


def uniform(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """(first, steps): P(X <= first + i) for i from 0, from where it can be told from 0 to where it is 1."""
    if rate <= 0:
        return 0, [1.0]
    reach = 12 * math.sqrt(rate) + 40
    first, last = max(0, int(rate - reach)), int(rate + reach)
    k = np.arange(first, last + 1)
    logs = k * math.log(rate) - rate - np.asarray([math.lgamma(x + 1) for x in k])
    return first, np.minimum(np.cumsum(np.exp(logs)), 1.0).tolist()


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, epochs: float, source_col: str, text_col: str) -> DataFrame:
    """(source_key, rate, first, steps) of each source.

    A document's size is its UTF-8 bytes and one. With `weights` a source's target is its weight over the sum of the
    weights of the sources that are there (0 if it has none); else it is its size to the power `alpha`, likewise.
    """
    size = F.octet_length(text_or_empty(text_col)).cast("long") + 1
    sizes = written(docs.select(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NULL)).alias("source_key"), size.alias("size")).groupBy("source_key").agg(F.sum("size").alias("size")))
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(float(alpha)))
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        given = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        target = F.coalesce(F.try_element_at(F.create_map(*given), F.col("source_key")), F.lit(0.0)) if given else F.lit(0.0)
    sized = sizes.withColumn("target", target)
    total, wanted = sized.agg(F.sum("size"), F.sum("target")).first()
    rate = F.col("target") / float(wanted or 1) * float(total or 0) * float(epochs) / F.col("size")

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [poisson_steps(r) for r in b["rate"]]
            yield b.assign(first=[f for f, _ in got], steps=[s for _, s in got])

    return written(sized.select("source_key", rate.alias("rate")).mapInPandas(steps, "source_key string, rate double, first long, steps array<double>"))


OUT = ("mix_rate", "mix_copies", "mix_copy", "mix_order")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, epochs: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, each row as often as its draw says, plus mix_rate, mix_copies, mix_copy and mix_order.

    mix_copy counts from 0; rows are dealt over all partitions by mix_order, a hash of seed, id and copy, and sorted by it
    within each, so that their order tells nothing of where they came from. Null sources are a source of their own. Rows
    of one id draw alike, repeated ones too; null ids are one id. Empty texts have size 1, and very long ones count
    whole. Of the input columns only those with the names of the four new ones, in any case, are replaced. An empty table
    gives an empty result.
    """
    rates = source_rates(docs, weights, alpha, epochs, source_col, text_col)
    few = rates.count() <= FEW
    cols = [c for c in docs.columns if c.lower() not in OUT]
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(NULL))
    key = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(NULL))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), key.alias("source_key"), ident.alias("ident"))
    drawn = base.join(F.broadcast(rates) if few else rates, "source_key")
    u = uniform(F.lit(seed), F.col("ident"))
    copies = F.when(F.col("rate") > 0, F.col("first") + F.size(F.filter("steps", lambda p: p <= u))).otherwise(0)
    drawn = drawn.withColumn("copies", copies.cast("long")).filter("copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    order = F.md5(F.concat_ws("\x1f", F.lit(f"{seed} order"), "ident", "copy"))
    out = out.withColumn("order", F.conv(F.substring(order, 1, 15), 16, 10).cast("long"))
    # Dealing by a hash shuffles as well as sorting by it does, and needs no sample of the rows beforehand.
    out = out.repartition("order").sortWithinPartitions("order")
    made = dict(zip(OUT, ("rate", "copies", "copy", "order"), strict=True))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in cols], *[F.col(c).alias(name) for name, c in made.items()])
