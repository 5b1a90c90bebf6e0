"""Sharding by jump consistent hashing, with DataFrame operations only.

A key is hashed to 64 bits; from there the linear congruential steps of jump hash (Lamping and Veach, 2014) give an
increasing sequence of buckets, and the last one below the number of shards is the shard. There is no ring table,
no state and no shuffle, and with one more shard a key either stays or goes to the new shard.

A step moves at least one bucket ahead, so as many steps as shards are exact. 48 steps are enough for all but a
vanishing share of keys; the others take the long way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.shared import numbered, spare, text_or_empty

#: The multiplier 2862933555777941757 of the published algorithm, in halves of 32 bits.
MULT_HI, MULT_LO = divmod(2862933555777941757, 1 << 32)
MASK = (1 << 32) - 1
SHORT = 48
#: Parts by which a shard is numbered at least, and rows of a part at most, in the mean.
PARTS, PART_ROWS = 64, 1 << 20


def _mul_low(a: Column, b: int) -> Column:
    """a * b modulo 2**32 for a below 2**32, without overflow of a long."""
    return ((a * (b & 0xFFFF)) + F.shiftleft((a * (b >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(MASK)


def _lcg(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * MULT + 1 modulo 2**64, in halves."""
    p0, p1 = lo * (MULT_LO & 0xFFFF), lo * (MULT_LO >> 16)
    low = p0 + F.shiftleft(p1.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(p1, 16)
    return (carry + _mul_low(lo, MULT_HI) + _mul_low(hi, MULT_LO)).bitwiseAND(MASK), low.bitwiseAND(MASK)


def key_halves(*keys: str, at: int = 1) -> tuple[Column, Column]:
    """64 bits of the MD5 of the keys' text, from its hex digit `at` on, as two unsigned halves. Null differs from every text."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\x00null")) for k in keys])
    digest = F.md5(joined)
    return tuple(F.conv(F.substring(digest, at + k, 8), 16, 10).cast("long") for k in (0, 8))


def jump_shards(hi: Column, lo: Column, n_shards: int) -> Column:
    """Struct (shard, grown): the shard among n_shards, and among n_shards + 1."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        h, low = _lcg(s["hi"], s["lo"])
        ahead = ((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1).cast("double"))).cast("long")
        nxt = F.struct(
            h.alias("hi"), low.alias("lo"), ahead.alias("j"),
            F.when(ahead < n_shards, ahead).otherwise(s["shard"]).alias("shard"),
            F.when(ahead < n_shards + 1, ahead).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["j"] > n_shards, s).otherwise(nxt)

    zero = F.lit(0).cast("long")
    # The first bucket of every key is 0.
    start = F.struct(hi.alias("hi"), lo.alias("lo"), zero.alias("j"), zero.alias("shard"), zero.alias("grown"))
    most = n_shards + 1
    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(most, SHORT))), start, step)
    if most > SHORT:
        end = F.when(end["j"] > n_shards, end).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step))
    return F.struct(end["shard"].cast("int").alias("shard"), end["grown"].cast("int").alias("grown"))


def assign_shards(df: DataFrame, keys: list[str], n_shards: int) -> DataFrame:
    """All rows and columns of `df` plus `shard` and `grown_shard` (with one more shard); no shuffle.

    Equal keys get equal shards, also null ones. Of the input columns only those named shard or grown_shard, in any
    case, are replaced.
    """
    name = spare(df, "jump")
    halves = F.struct(*[h.alias(n) for h, n in zip(key_halves(*keys), ("hi", "lo"), strict=True)])
    out = df.withColumn(name, halves)
    cols = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "grown_shard")]
    out = out.select(*cols, jump_shards(F.col(f"`{name}`.hi"), F.col(f"`{name}`.lo"), n_shards).alias(name))
    return out.select(*cols, F.col(f"`{name}`.shard").alias("shard"), F.col(f"`{name}`.grown").alias("grown_shard"))


def number_slots(df: DataFrame, order: list[str], parts: int = PARTS) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard, which is dealt over `parts` groups by a digest of order[0]."""
    return numbered(df, "shard", key_halves(order[0], at=17)[0] % parts, order, "slot")


def shard_documents(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with shard, grown_shard, size (UTF-8 bytes of the text plus 16), text_crc32 (unsigned) and slot.

    A null text has size 16 and the checksum 0 of the empty text; very long texts are read whole. Rows of one id share a
    shard and get slots of their own, in the order of checksum and size and, where they repeat, in any order. Null ids are
    one key. Ids may be of any type. Of the input columns only those with the names of the five new ones, in any case,
    are replaced. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    made = ("shard", "grown_shard", "size", "text_crc32", "slot")
    cols = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    sized = docs.select(*cols, (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"))
    # So many parts that one is sorted by a task; the number of rows is in the tables' footers.
    parts = max(PARTS, -(-docs.count() // (n_shards * PART_ROWS)))
    return number_slots(assign_shards(sized, [id_col], n_shards), [id_col, "text_crc32", "size"], parts)


def write_shards(docs: DataFrame, n_shards: int, path: str, id_col: str = "doc_id") -> None:
    """Writes `docs` as Parquet, one folder a shard; tasks append to every folder, so no shard needs one task."""
    assign_shards(docs, [id_col], n_shards).write.partitionBy("shard").parquet(path)
