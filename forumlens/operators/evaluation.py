"""Outcomes of tasks, joined to what was expected of them, and their ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forumlens.session import saved


def judged(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes by task_id with what their tasks expect, and task_success: the status, and all tools, are the expected.

    tasks: task_id, category, expected_status, expected_tools, faulted; outcomes: task_id, variant, status, tools and figures.
    """
    right = (F.col("status") == F.col("expected_status")) & (F.size(F.array_except("expected_tools", "tools")) == 0)
    return outcomes.join(tasks, "task_id").withColumn("task_success", right)


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, p50, p95) of each group with values: the 50th percentile is interpolated, the 95th the nearest rank; both exact.

    Values are counted, and their counts dealt by ranges of the value: sums of the ranges tell which of them hold the
    wanted ranks, and only these are summed up by value. So no task holds a group.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = saved(counts.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()))
    of = Window.partitionBy("g")  # a row a range
    parts = dealt.groupBy("g", "part").agg(F.sum("n").alias("held")).withColumn("total", F.sum("held").over(of))
    parts = parts.withColumn("before", F.sum("held").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held"))
    middle = (F.col("total") + 1) / 2
    ranks = {"low": F.floor(middle), "high": F.ceil(middle), "p95": F.greatest(F.ceil(F.col("total") * 0.95), F.lit(1))}
    parts = parts.select(F.col("g").alias("_g"), F.col("part").alias("_part"), "held", "before", *[r.alias(f"_{k}") for k, r in ranks.items()])
    inside = lambda k, first, n: (F.col(f"_{k}") > first) & (F.col(f"_{k}") <= first + n)
    wanted = parts.filter(inside("low", F.col("before"), F.col("held")) | inside("high", F.col("before"), F.col("held")) | inside("p95", F.col("before"), F.col("held")))
    held = dealt.join(wanted, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("first", F.col("before") + upto - F.col("n"))
    at = held.groupBy("g").agg(*[F.max(F.when(inside(k, F.col("first"), F.col("n")), F.col("v"))).alias(k) for k in ranks])
    return at.select(F.col("g").alias(by), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0.5 * F.col("low") + 0.5 * F.col("high")).alias("p50"), "p95")


def summarise(rows: DataFrame, digits: int = 6) -> DataFrame:
    """A row a variant. A ratio is null where nothing counts for it. The 95th percentile is the nearest rank."""
    share = lambda ok, of=None: F.round(F.avg(F.when(F.lit(True) if of is None else of, ok.cast("double"))), digits)
    shares = rows.groupBy("variant").agg(
        F.count("*").alias("task_count"), share(F.col("task_success")).alias("task_success"), share(F.col("argument_valid")).alias("argument_validity"),
        share(F.col("logical_tool_success"), F.col("tool_total") > 0).alias("tool_execution_success"),
        F.round(F.try_divide(F.sum("tool_success"), F.sum("tool_total")), digits).alias("tool_attempt_success"),
        share(F.col("citations") > 0, F.col("status") == "completed").alias("citation_completeness"), share(F.col("recovered"), F.col("faulted")).alias("failure_recovery"),
        F.round(F.avg("tool_total"), digits).alias("average_tool_calls"),
    )
    times = percentiles(rows, "variant", "latency_ms").select(F.col("variant").alias("_of"), F.round("p50", digits).alias("p50_latency_ms"), F.round("p95", digits).alias("p95_latency_ms"))
    return shares.join(times, F.col("variant").eqNullSafe(F.col("_of")), "left").drop("_of")
