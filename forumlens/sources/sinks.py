"""Keyed tables on Parquet, JSON-line sinks and materialised panels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.operators.dedup import keep_one, last_wins
from forumlens.session import remove


#: Rows without a key whose text is kept of a merge.
ERRORS = 5


class KeyedTable:
    """A table of one row a key, in buckets by a hash of the key: a merge rewrites the buckets that its rows fall into.

    `data/vN/bucket=B` has the rows of a bucket as the merge N left them; the manifest N names the folder of each bucket, so
    that readers see a whole version or the one before, and a merge that breaks off leaves the table as it was. A manifest
    also counts the rows that its merge took and those without a key, of which it keeps the first as text. A merge of the
    same batch again makes the same table, so deliveries may repeat. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, stamp: str, buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.stamp, self.buckets = spark, path.rstrip("/"), schema, key, stamp, buckets

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._at("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """folders: the version of each bucket's folder; rows, keyless and errors: of the merge that made the version."""
        v = self.versions()
        if not v:
            return {"folders": {}, "rows": 0, "keyless": 0, "errors": []}
        fs, p = self._at(f"manifests/{version or v[-1]}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        fs, draft = self._at(f"manifests/{version}.draft")
        out = fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        fs.rename(draft, self._at(f"manifests/{version}.json")[1])

    def read(self) -> DataFrame:
        return self._read(self.manifest()["folders"])

    def _read(self, folders: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/v{v}/bucket={b}" for b, v in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, keep: int = 2) -> dict:
        """Of a key the row of the latest stamp stays, of equal stamps the batch's; gives the new manifest.

        The last `keep` versions stay, so that readers of the one before can finish.
        """
        rows = batch.select(*self.schema.names).persist()
        try:
            keyless = rows.filter(F.col(self.key).isNull())
            bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
            found = {r.bucket: r.n for r in rows.select(F.when(F.col(self.key).isNotNull(), bucket).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect()}
            missing = found.pop(None, 0)
            errors = [r[0] for r in keyless.select(F.to_json(F.struct("*"))).limit(ERRORS).collect()] if missing else []
            done, old = self.versions(), self.manifest()["folders"]
            version = done[-1] + 1 if done else 1
            if found:
                # A key's rows of the batch become one before they are shuffled by bucket.
                new = last_wins(rows.filter(F.col(self.key).isNotNull()).withColumn("_tie", F.lit(0)), [self.key], self.stamp, "_tie").drop("_tie")
                both = self._read({b: v for b, v in old.items() if int(b) in found}).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
                dealt = both.withColumn("bucket", bucket).repartition(len(found), "bucket")
                merged = keep_one(dealt, ["bucket", self.key], [F.col(self.stamp).desc_nulls_last(), F.col("_new").desc()]).drop("_new")
                merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
            manifest = {"folders": old | {str(b): version for b in found}, "rows": sum(found.values()), "keyless": missing, "errors": errors}
            self._publish(version, manifest)
        finally:
            rows.unpersist()
        self._forget([*done, version], keep)
        return manifest

    def _forget(self, versions: list[int], keep: int) -> None:
        """Removes manifests but the last, and folders that none of these names."""
        kept, gone = versions[-keep:], versions[:-keep]
        if gone:
            named = {(v, b) for k in kept for b, v in self.manifest(k)["folders"].items()}
            for b, v in {(b, v) for k in gone for b, v in self.manifest(k)["folders"].items()}:
                if (v, b) not in named:
                    remove(self.spark, f"{self.path}/data/v{v}/bucket={b}")
            for v in gone:
                remove(self.spark, f"{self.path}/manifests/{v}.json")


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> int:
    """JSON lines, and how many; NaN, which is no JSON, becomes null. order: sorted over the files, by their names."""
    fix = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    seen = Observation()
    out = df.withColumns(fix) if fix else df
    out = out.orderBy(*order) if order else out
    out.observe(seen, F.count(F.lit(1)).alias("n")).write.json(path)
    return seen.get["n"]


def refresh_panels(panels: dict[str, DataFrame], path: str) -> None:
    """Each panel's table, replaced as a whole."""
    for name, df in panels.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_panel(spark: SparkSession, path: str, name: str, **key) -> DataFrame:
    """A panel, or its rows of a key, which is pushed down to the scan."""
    out = spark.read.parquet(f"{path}/{name}")
    for c, v in key.items():
        out = out.filter(F.col(c) == v)
    return out
