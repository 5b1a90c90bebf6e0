"""Sketches a day that merge for any range of days, without reading the rows again.

Distinct values are HyperLogLog sketches and quantiles KLL sketches, both Spark's own: they are aggregated in part by each
task, so that a hot key is no one's, and have a size that does not grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct sketch, whose relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Size of a quantile sketch; its normalised rank error is below RANK_ERROR with a confidence of 99 %.
KLL_K, RANK_ERROR = 200, 0.0165


def distinct_error(lg_k: int = LG_K) -> float:
    """Three standard errors of a distinct count."""
    return 3 * 1.04 / 2 ** (lg_k / 2)


def daily(df: DataFrame, ts: str, keys: list[str], member: str, value: str) -> DataFrame:
    """(day, keys, n, members, values): a row for each day and key, with the sketches of `member` and `value`.

    Nulls are no members and no values; rows without a time have the null day, which no range takes.
    """
    by = df.groupBy(F.col(ts).cast("date").alias("day"), *keys)
    return by.agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(member), F.lit(LG_K)).alias("members"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("values"))


def over(days: DataFrame, keys: list[str], quantiles: list[float], start=None, end=None) -> DataFrame:
    """(keys, n, members, quantiles): estimates for the days from `start` to `end`, both included, of daily()'s rows."""
    inside = days.filter("day is not null")
    inside = inside if start is None else inside.filter(F.col("day") >= F.lit(start))
    inside = inside if end is None else inside.filter(F.col("day") <= F.lit(end))
    merged = inside.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("members").alias("_m"), F.kll_merge_agg_double("values").alias("_v"))
    points = F.kll_sketch_get_quantile_double("_v", F.array(*map(F.lit, quantiles)))
    return merged.select(*keys, "n", F.hll_sketch_estimate("_m").alias("members"), points.alias("quantiles"))
