"""Dashboard aggregations. Bucket order is count descending, then key ascending; null keys are no bucket, "" is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.functions.text import col

INTERVALS = ("day", "week", "month", "quarter", "year")


def _name(key: str | Column, name: str | None) -> str:
    return name or (key if isinstance(key, str) else "key")


def terms(df: DataFrame, key: str | Column, size: int = 20, name: str | None = None, missing: str | None = None, min_count: int = 1, exclude: str | None = None, by_key: bool = False) -> DataFrame:
    """The `size` largest buckets (or the first by key) as (key, count).

    missing: the key of rows without one; min_count and exclude (an anchored pattern) act before the cut.
    """
    name = _name(key, name)
    c = col(key) if missing is None else F.coalesce(col(key), F.lit(missing))
    out = df.select(c.alias(name)).filter(F.col(name).isNotNull())
    if exclude is not None:
        out = out.filter(~F.col(name).rlike(f"^(?:{exclude})$"))
    out = out.groupBy(name).agg(F.count("*").alias("count"))
    if min_count > 1:
        out = out.filter(F.col("count") >= min_count)
    return out.orderBy(*([name] if by_key else [F.desc("count"), name])).limit(size)


def nested_terms(df: DataFrame, outer: str, inner: str, outer_size: int = 20, inner_size: int = 10, inner_by_key: bool = False) -> DataFrame:
    """(outer, outer_count, inner, count): the largest outer buckets and within each the first inner ones.

    One aggregation makes the pairs; both cuts work on those.
    """
    pairs = df.filter(F.col(outer).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("count"))
    top = pairs.groupBy(outer).agg(F.sum("count").alias("outer_count")).orderBy(F.desc("outer_count"), outer).limit(outer_size)
    order = [F.col(inner)] if inner_by_key else [F.desc("count"), F.col(inner)]
    ranked = pairs.filter(F.col(inner).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(outer).orderBy(*order)))
    return ranked.filter(F.col("_r") <= inner_size).join(F.broadcast(top), outer).select(outer, "outer_count", inner, "count")


def bucket(ts: str | Column, interval: str) -> Column:
    if interval not in INTERVALS:
        raise ValueError(f"interval must be one of {INTERVALS}")
    return F.date_trunc(interval, col(ts)).cast("date")


def date_histogram(df: DataFrame, ts: str, interval: str, by: list[str] | None = None, densify: bool = False) -> DataFrame:
    """(date, *by, count) by calendar interval, weeks from Monday; densify: empty buckets between first and last too."""
    by = by or []
    counts = df.filter(F.col(ts).isNotNull()).groupBy(bucket(ts, interval).alias("date"), *by).agg(F.count("*").alias("count"))
    if not densify:
        return counts
    step = F.expr({"quarter": "interval 3 month"}.get(interval, f"interval 1 {interval}"))
    ends = counts.groupBy(*by).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = ends.select(*by, F.explode(F.sequence("_a", "_b", step)).alias("date"))
    return days.join(counts, ["date", *by], "left").select("date", *by, F.coalesce("count", F.lit(0)).alias("count"))


def stats(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    r = lambda c, n: F.round(c, digits).alias(n)
    out = [F.count(value).alias("count"), r(F.min(value), "min"), r(F.max(value), "max"), r(F.avg(value), "avg"), r(F.sum(value), "sum")]
    return df.groupBy(*(by or [])).agg(*out)


def cardinality(df: DataFrame, value: str, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    count = F.count_distinct(value) if exact else F.approx_count_distinct(value)
    return df.groupBy(*(by or [])).agg(count.alias("distinct"))


def label_ratios(df: DataFrame, by: str | Column, label: str, negative: str, positive: str, name: str | None = None) -> DataFrame:
    """(key, count, neg, pos, neg_ratio, pos_ratio), shares of all rows of the key, rounded to four digits."""
    name = _name(by, name)
    n = lambda v: F.count(F.when(F.col(label) == v, 1))
    ratio = lambda v: F.round(n(v) / F.greatest(F.lit(1), F.count("*")), 4)
    return df.groupBy(col(by).alias(name)).agg(F.count("*").alias("count"), n(negative).alias("neg"), n(positive).alias("pos"), ratio(negative).alias("neg_ratio"), ratio(positive).alias("pos_ratio"))


def label_pivot(df: DataFrame, by: str, label: str, labels: list[str], value: str) -> DataFrame:
    """(by, count, avg, one count a label) in one pass; the labels are given, so no pass goes to find them."""
    out = [F.count(F.when(F.col(label) == x, 1)).alias(x) for x in labels]
    return df.groupBy(by).agg(F.count("*").alias("count"), F.round(F.avg(value), 6).alias("avg"), *out)


def volume_with_metric(df: DataFrame, by: str, key: str, metric: str | Column) -> DataFrame:
    """(by, volume): rows, and for one key what its metric sums to as well."""
    added = F.when(F.col(by) == key, F.coalesce(F.sum(col(metric)), F.lit(0))).otherwise(0)
    return df.groupBy(by).agg((F.count("*") + added).cast("bigint").alias("volume"))


def rollup_labels(df: DataFrame, raw: str, label: Column, first: int = 500, size: int = 30, examples: int = 5) -> DataFrame:
    """(label, count, examples): the `first` largest raw values, relabelled, summed and cut to `size`."""
    top = terms(df, raw, first).withColumn("label", label).filter("label is not null")
    ranked = top.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("count"), raw)))
    shown = F.array_sort(F.collect_list(F.when(F.col("_r") <= examples, F.struct("_r", F.col(raw).alias("v")))))
    out = ranked.groupBy("label").agg(F.sum("count").alias("count"), F.array_join(F.transform(shown, lambda s: s["v"]), "; ").alias("examples"))
    return out.orderBy(F.desc("count"), "label").limit(size)


def multi_terms(df: DataFrame, keys: list[str]) -> DataFrame:
    """(panel, key, count) of several fields and of all rows, in one scan by grouping sets.

    The total is the sum over the first field's values, null among them, and so 0 for an empty table.
    """
    keys = list(dict.fromkeys(keys))
    typed = df.select(*[F.col(k).cast("string").alias(k) for k in keys])
    out = typed.groupingSets([[k] for k in keys], *keys).agg(F.count("*").alias("count"), F.grouping_id().alias("_g"))
    n = len(keys)
    panel, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        here = F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i))
        panel, key = F.when(here, k).otherwise(panel), F.when(here, F.col(k)).otherwise(key)
    counts = out.select(panel.alias("panel"), key.alias("key"), "count")
    total = counts.filter(F.col("panel") == keys[0]).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    return counts.filter("key is not null").union(total.select(F.lit("total"), F.lit(None).cast("string"), "count"))


def coverage(df: DataFrame, by: str, source: str, period: str) -> DataFrame:
    """(by, count, sources, first, last); sources are the distinct ones, sorted and joined."""
    sources = F.array_join(F.array_sort(F.collect_set(source)), ",")
    return df.groupBy(by).agg(F.count("*").alias("count"), sources.alias("sources"), F.min(period).alias("first"), F.max(period).alias("last"))


def percentiles(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, p50, p95): the interpolated median and the nearest-rank 95th percentile."""
    at = lambda f, p: F.expr(f"{f}({p}) within group (order by {value})")
    return df.groupBy(by).agg(F.round(at("percentile_cont", 0.5), 6).alias("p50"), F.round(at("percentile_disc", 0.95), 6).alias("p95"))


def floor_quantile(df: DataFrame, value: str, by: str, q: float) -> DataFrame:
    """(by, quantile): the value at the floor of q * (n - 1) in order; ranked by a window, so no list is gathered."""
    w = Window.partitionBy(by)
    r = df.select(by, value).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return r.filter(F.col("_r") == F.floor(F.lit(q) * (F.col("_n") - 1))).select(by, F.round(value, 6).alias("quantile"))


def word_counts(df: DataFrame, words: Column, ts: str, id_col: str, recent: int = 3000, size: int = 100) -> DataFrame:
    """(word, count): the commonest words of the most recent rows."""
    last = df.orderBy(F.col(ts).desc_nulls_last(), id_col).limit(recent)
    return last.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(size)


def day_over_day(df: DataFrame, ts: str, by: str, day: Column) -> DataFrame:
    """(by, before, after, ratio, alert) of the day and the one before it; a key missing on a day counts 0.

    alert: ratio below 0.2 or above 3; none if nothing was there before, or both are below 100.
    """
    counts = df.withColumn("_d", F.col(ts).cast("date")).filter((F.col("_d") == day) | (F.col("_d") == F.date_sub(day, 1)))
    both = counts.groupBy(by).agg(F.count(F.when(F.col("_d") < day, 1)).alias("before"), F.count(F.when(F.col("_d") == day, 1)).alias("after"))
    ratio = F.round(F.try_divide(F.col("after"), F.col("before")), 4)
    alert = (F.col("before") > 0) & ~((F.col("before") < 100) & (F.col("after") < 100)) & ((F.col("ratio") < 0.2) | (F.col("ratio") > 3))
    return both.withColumn("ratio", ratio).withColumn("alert", F.coalesce(alert, F.lit(False)))


def zero_streaks(df: DataFrame, ts: str, key: str, alert: int = 50) -> DataFrame:
    """(key, start, days, alert): runs of days without rows between a key's first and last day, by gaps."""
    days = df.select(key, F.col(ts).cast("date").alias("_d")).distinct()
    gap = F.date_diff("_d", F.lag("_d").over(Window.partitionBy(key).orderBy("_d"))) - 1
    runs = days.withColumn("days", gap).filter("days > 0")
    return runs.select(key, F.date_sub("_d", F.col("days")).alias("start"), "days", (F.col("days") >= alert).alias("alert"))
