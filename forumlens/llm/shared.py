"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.session import fresh_dir, remove

#: The folder that tables are written to within scratch().
_folder: ContextVar[str | None] = ContextVar("folder", default=None)


def _write(df: DataFrame, folder: str | None) -> DataFrame:
    spark = df.sparkSession
    path = fresh_dir(spark, "table")
    path = f"{folder}/{path.rsplit('/', 1)[1]}" if folder else path
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage is cut, and lost executors lose nothing."""
    return _write(df, _folder.get())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written within go at its end, but for those that the function it gives has written."""
    outer, mine = _folder.get(), fresh_dir(spark, "scratch")
    token = _folder.set(mine)
    try:
        yield lambda df: _write(df, outer)
    finally:
        _folder.reset(token)
        remove(spark, mine)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and all else as it is; the slower translate() is for text beyond ASCII, of which lower() changes more."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def spare(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, group: str, part: Column, order: list[str], name: str) -> DataFrame:
    """`df` with `name`, a long gapless from 0 within each value of `group`; no task holds a group.

    `part` deals each group over so many parts that a task can sort one. Their sizes are joined by group and part, by
    which the rows are dealt already. `group` is not null. The columns of `df` may have any names but that of `name`.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    rows = df.select(row, F.col(f"`{group}`").alias("g"), part.cast("int").alias("part"), *[F.col(f"`{c}`").alias(f"o{k}") for k, c in enumerate(order)])
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("g", "part").agg(F.count("*").alias("n"))
    sizes = sizes.select(F.col("g").alias("h"), F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("g", "part").orderBy(*[f"o{k}" for k in range(len(order))])
    ranked = rows.withColumn("rank", F.row_number().over(within).cast("long") - 1)
    out = ranked.join(sizes, (F.col("g") == F.col("h")) & (F.col("part") == F.col("of")))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in df.columns], (F.col("first") + F.col("rank")).alias(name))
