"""Readers of JSON lines, JSON arrays and zipped TSV, and file discovery, with (file, line) provenance."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines with a declared schema. FAILFAST stops at a bad line; PERMISSIVE keeps it in `_corrupt_record`."""
    if mode == "PERMISSIVE":
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else T.StructType(list(schema.fields))
        schema = schema.add("_corrupt_record", T.StringType())
    return spark.read.schema(schema).option("mode", mode).json(path)


def numbered_lines(spark: SparkSession, path: str | list[str], through: bool = False) -> DataFrame:
    """(file, line, value): the lines of text files, counted from 1, however the files are split.

    through: the files are parts of one, by the order of their names, and lines are counted on from part to part.
    Lines are ranked within their split; the splits before it say how many lines came before. So no task holds a file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    order = Window.orderBy("file", "block") if through else Window.partitionBy("file").orderBy("block")  # a row a split
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = lines.withColumn("r", F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return ranked.join(sizes, ["file", "block"]).select("file", (F.col("before") + F.col("r")).alias("line"), "value")


def read_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, record) of lines that are JSON objects, as VARIANT; other JSON and blank lines are dropped."""
    lines = numbered_lines(spark, path).select("file", "line", F.trim("value").alias("value"))
    parsed = lines.filter("value <> ''").withColumn("record", F.try_parse_json("value"))
    return parsed.filter(F.schema_of_variant("record").startswith("OBJECT")).select("file", "line", "record")


def count_bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, read, usable, skipped, not_json, not_object) a file; blank lines are not counted."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value")).filter("value <> ''")
    v = F.try_parse_json("value")
    none, other = F.count(F.when(v.isNull(), 1)), F.count(F.when(~F.schema_of_variant(v).startswith("OBJECT"), 1))
    by = lines.groupBy("file").agg(F.count("*").alias("read"), none.alias("not_json"), other.alias("not_object"))
    return by.select("file", "read", (F.col("read") - F.col("not_json")).alias("usable"), F.col("not_json").alias("skipped"), "not_json", "not_object")


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def list_files(spark: SparkSession, path: str | list[str], pattern: str = "*", start: str | None = None, end: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """(file, stamp, root) below one or several folders, in order of folders and names; each file once.

    `start` and `end` (yyyyMMdd) prune by the day in the name; the end day counts whole, as days are compared and not stamps.
    A stamp is looked for below the root only: the folders above it have digits of their own, such as those of an application.
    without: names that match any of these expressions are left out. A folder that is not there is passed over.
    """
    roots = [path] if isinstance(path, str) else list(path)
    out = None
    for k, root in enumerate(roots):
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            warnings.warn(f"no folder {root}", stacklevel=2)
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
        above = len(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())
        found = found.select(F.col("path").alias("file"), F.lit(k).alias("root"), F.lit(above).alias("above"))
        out = found if out is None else out.union(found)
    if out is None:
        raise FileNotFoundError(", ".join(roots))
    files = out.groupBy("file").agg(F.min("root").alias("root"), F.min_by("above", "root").alias("above"))
    for shape in without:
        files = files.filter(~F.element_at(F.split("file", "/"), -1).rlike(shape))
    files = files.withColumn("stamp", F.nullif(F.regexp_extract(F.substring("file", F.col("above") + 1, F.length("file")), "(?:^|[^0-9a-f])([0-9]{14})(?:[^0-9a-f]|$)", 1), F.lit("")))
    day = F.substring("stamp", 1, 8)
    if start:
        files = files.filter(day >= start)
    if end:
        files = files.filter(day <= end)
    return files.select("file", "stamp", "root").orderBy("root", "file")


def official_files(spark: SparkSession, path: str) -> DataFrame:
    """Official files of the newer release's folder before those of the older one."""
    return list_files(spark, [f"{path}/official_sources_json_v3", f"{path}/official_sources_json_v2"], "*.jsonl")


def latest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("file", "stamp").alias("file"), F.max("stamp").alias("stamp"))


#: The columns that are taken of the feed's rows, and their positions there.
GKG_AT = {"stamp": 1, "source": 3, "url": 4, "themes": 7, "v2_themes": 8, "locations": 9}
GKG = T.StructType([T.StructField(n, T.StringType()) for n in ("file", *GKG_AT)])


def unzipped_rows(zips: DataFrame) -> DataFrame:
    """The rows of the first member of each zip of (path, content): tab-separated, UTF-8 with replacement; those under 8 columns go.

    A zip cannot be split, so each is one row of work and is read as a stream of lines.
    """

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    if not names:
                        continue
                    with io.TextIOWrapper(z.open(names[0]), "utf-8", "replace", newline="\n") as lines:
                        for line in lines:
                            cells = line.rstrip("\r\n").split("\t")
                            if len(cells) >= 8:
                                rows.append((file, *(cells[i] if i < len(cells) else None for i in GKG_AT.values())))
                            if len(rows) >= 10_000:
                                yield pd.DataFrame(rows, columns=GKG.names)
                                rows = []
                yield pd.DataFrame(rows, columns=GKG.names)

    return zips.select("path", "content").mapInPandas(unzip, GKG)


def read_zipped_tsv(spark: SparkSession, path: str) -> DataFrame:
    """unzipped_rows() of each zip below `path`."""
    return unzipped_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path))


def profile_threads(df: DataFrame, key: str, order: str) -> DataFrame:
    """(threads, with_items, items): threads, those with items after their head, and how many such items there are."""
    per = df.groupBy(key).agg(F.count(order).alias("n"))
    return per.agg(F.count("*").alias("threads"), F.count(F.when(F.col("n") > 1, 1)).alias("with_items"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("items"))
