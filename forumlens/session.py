"""SparkSession factory and table loader."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "forumlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every query relies on: UTC timestamps and adaptive execution.

    Partition counts are left to the cluster unless `shuffle_partitions` is given.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.ui.enabled", os.environ.get("SPARK_UI", "false"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "12g").config("spark.driver.host", "127.0.0.1")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session makes one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="forumlens-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir() named, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not taken; what is written there goes when the application ends, at the latest."""
    own = f"{shared_dir(spark)}/forumlens-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: it is computed once, and lost executors lose nothing."""
    path = fresh_dir(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
