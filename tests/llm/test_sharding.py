import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.llm import sharding

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("shard", T.StringType())])


def jump(key: int, n: int) -> int:
    """The published algorithm."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 47, 48, 500])
def test_shards_are_those_of_jump_hash(spark, n):
    ids = list(range(-50, 400)) + [2**62, -(2**63)]
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(spark.createDataFrame([(i, "", "x") for i in ids], DOCS), ["doc_id"], n).collect()}
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16)
    assert got == {i: (jump(key(i), n), jump(key(i), n + 1)) for i in ids}
    assert all(a == b or b == n for a, b in got.values())


def test_long_jump_sequences_are_exact(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SHORT", 2)
    df = spark.range(500).select(sharding.jump_shards(*sharding.key_halves("id"), 100).alias("s"), "id")
    key = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16)
    assert all(r.s.shard == jump(key(r.id), 100) for r in df.collect())


def test_documents(spark):
    texts = ["a", "é" * 10, "", None, "x" * 200_000]
    rows = [(i, texts[i % 5], "old") for i in range(2000)] + [(7, "again", None), (7, "again", None), (None, "n", None), (None, None, None)]
    out = sharding.shard_documents(spark.createDataFrame(rows, DOCS), 40).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1 and len({r.shard for r in out if r.doc_id is None}) == 1
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), 40).count() == 0


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(df, 7, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    want = sharding.assign_shards(df, ["doc_id"], 7).select("doc_id", "shard")
    assert sorted(map(tuple, back.select("doc_id", "shard").collect())) == sorted(map(tuple, want.collect()))
