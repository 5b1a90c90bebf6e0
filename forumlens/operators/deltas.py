"""Panels that follow a keyed table by what a batch changes, without reading the table again.

A panel is a table of sums by keys. Sums are additive, so a batch adds its new rows and takes away the rows that these
replace; a batch's changes of all panels are one aggregation of the changed rows, and each panel's new state is the old one,
which is as small as the panel, and that delta.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forumlens.session import remove
from forumlens.sources.sinks import KeyedTable

#: State of all panels of a store: the panel's name, its keys as texts, its rows, and its sums by name.
STATE = "panel string, keys array<string>, n bigint, sums map<string, decimal(38, 6)>"


@dataclass(frozen=True)
class Panel:
    """keys: columns that make a row of the panel; sums: what is added up besides the count; where: rows that count."""

    keys: list[Column]
    sums: dict[str, Column] = field(default_factory=dict)
    where: Column | None = None


def changes(table: KeyedTable, batch: DataFrame) -> DataFrame:
    """The table's columns and `_sign`: 1 for each row that merging the batch would bring in, -1 for each that it would replace.

    Of the table only the buckets of the batch's keys are read. Rows without a key, older ones and exact repeats change nothing.
    """
    key, stamp, names = table.key, table.stamp, table.schema.names
    bucket = F.pmod(F.xxhash64(key), F.lit(table.buckets)).cast("int")
    new = batch.select(*names).filter(F.col(key).isNotNull())
    touched = {str(r[0]) for r in new.select(bucket).distinct().collect()}
    folders = {b: v for b, v in table.manifest()["folders"].items() if b in touched}
    newest = Window.partitionBy(key).orderBy(F.col(stamp).desc_nulls_last(), F.to_json(F.struct(*names)).desc())
    new = new.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").drop("_r")
    row = lambda df, name: df.select(F.col(key).alias("_key"), F.struct(*names).alias(name))
    both = row(new, "_new").join(row(table._read(folders), "_old"), "_key", "left")
    later = F.col("_old").isNull() | F.col(f"_old.`{stamp}`").isNull() | (F.col(f"_new.`{stamp}`") >= F.col(f"_old.`{stamp}`"))
    both = both.filter(later & ~F.col("_new").eqNullSafe(F.col("_old")))
    signed = F.explode(F.array(F.struct(F.col("_new").alias("row"), F.lit(1).alias("sign")), F.struct(F.col("_old").alias("row"), F.lit(-1).alias("sign")))).alias("c")
    return both.select(signed).filter("c.row is not null").select("c.row.*", F.col("c.sign").alias("_sign"))


class PanelStore:
    """The panels of one table, as versions below `path`, numbered as those of the table: readers see a whole one."""

    def __init__(self, spark: SparkSession, path: str, panels: dict[str, Panel]):
        self.spark, self.path, self.panels = spark, path.rstrip("/"), panels

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def state(self, version: int | None = None) -> DataFrame:
        """The state of the last version, or of one; version 0 is empty."""
        done = self.versions()
        version = (done[-1] if done else 0) if version is None else version
        if version and version not in done:
            raise ValueError(f"the panels have no version {version}")
        return self.spark.read.schema(STATE).parquet(f"{self.path}/v{version}") if version else self.spark.createDataFrame([], STATE)

    def delta(self, changed: DataFrame) -> DataFrame:
        """What `changed` (rows and `_sign`) adds to the state: one aggregation for all panels."""
        amount = lambda c: F.coalesce(c.cast("decimal(28, 6)"), F.lit(0)) * F.col("_sign")
        parts = [
            F.when(F.lit(True) if p.where is None else p.where, F.struct(
                F.lit(name).alias("panel"), (F.array(*[k.cast("string") for k in p.keys]) if p.keys else F.array().cast("array<string>")).alias("keys"),
                F.col("_sign").cast("long").alias("n"), F.array(*[F.struct(F.lit(s).alias("of"), amount(c).cast("decimal(38, 6)").alias("x")) for s, c in p.sums.items()]).cast("array<struct<of: string, x: decimal(38, 6)>>").alias("sums"),
            )) for name, p in self.panels.items()
        ]
        rows = changed.select(F.explode(F.array(*parts)).alias("p")).filter("p is not null").select("p.*")
        return _added(rows.select("panel", "keys", "n", F.map_from_entries("sums").alias("sums")))

    def refresh(self, changed: DataFrame, version: int, keep: int = 2) -> None:
        """Version + 1: the changes added to `version`; rows of a panel that count nothing any more go.

        A refresh of the same version again replaces what it made before.
        """
        new = _added(self.state(version).union(self.delta(changed))).filter("n <> 0")
        new.write.mode("overwrite").parquet(f"{self.path}/v{version + 1}")
        for old in [v for v in self.versions() if v <= version + 1 - keep]:
            remove(self.spark, f"{self.path}/v{old}")

    def read(self, panel: str) -> DataFrame:
        """(keys, n, sums) of one panel."""
        return self.state().filter(F.col("panel") == panel).drop("panel")


def _added(rows: DataFrame) -> DataFrame:
    """Rows of STATE with equal panel and keys added up."""
    counted = rows.groupBy("panel", "keys").agg(F.sum("n").alias("n"))
    each = rows.select("panel", "keys", F.explode("sums").alias("of", "x")).groupBy("panel", "keys", "of").agg(F.sum("x").cast("decimal(38, 6)").alias("x"))
    sums = each.groupBy("panel", "keys").agg(F.map_from_entries(F.collect_list(F.struct("of", "x"))).alias("sums"))
    out = counted.join(sums, ["panel", "keys"], "left")
    return out.select("panel", "keys", "n", F.coalesce("sums", F.create_map().cast("map<string, decimal(38, 6)>")).alias("sums"))


def follow(table: KeyedTable, store: PanelStore, batch: DataFrame) -> None:
    """Merges the batch into the table and its changes into the panels, whose version N is that of the table's version N.

    If it breaks off in between, the panels are a version ahead, which the batch replaces when it is delivered again.
    """
    held, done = batch.persist(), table.versions()
    try:
        store.refresh(changes(table, held), done[-1] if done else 0)
        table.merge(held)
    finally:
        held.unpersist()
