"""Keyed deduplication, idempotent upserts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first `most` rows of each key in the given order. Spark cuts each task's rows of a key before it shuffles."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def keep_one(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order; rows whose key is null are dropped, as they have no identity."""
    return first_per_group(df.dropna(subset=keys), keys, order, 1)


def first_wins(df: DataFrame, keys: list[str], position: list[str]) -> DataFrame:
    """By position in the input, such as (file number, line number): Spark itself keeps no input order."""
    return keep_one(df, keys, position)


def last_wins(df: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    return keep_one(df, keys, [F.col(stamp).desc_nulls_last(), F.col(tie).desc()])


def best_wins(df: DataFrame, keys: list[str], score: str, arrival: str) -> DataFrame:
    """The highest score; of equal ones the earliest."""
    return keep_one(df, keys, [F.col(score).desc_nulls_last(), F.col(arrival)])


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Old rows replaced and new ones added, whole rows by key; applying it twice changes nothing."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, [key], stamp, "_new").drop("_new")


def not_processed(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def has_fields(record: str, required: list[str]) -> Column:
    """Whether a map column has all the required keys."""
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.map_keys(record))) == 0
