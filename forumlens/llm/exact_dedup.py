"""Exact deduplication by skew-safe combining, with DataFrame operations only.

Three merges, each of which compares the full normalised content and not only its digest:

1. local: Spark's map-side partial aggregation merges the copies that one task sees;
2. salted: what is left is merged by (digest, salt, content), so that a content with very many copies is
   spread over `salts` reducers;
3. global: the winners of the salts, at most `salts` rows a content, are merged by (digest, content).

The contents of one digest are numbered; where a digest has more than one content (a collision), documents find
their group by content, else by digest. The group table without texts is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.shared import text_or_empty, written

SALTS = 8


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.sha2(text, 256)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_of) -> DataFrame:
    """One row a distinct content: digest, content, keep_id (smallest id), group_size."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), normalised(text_or_empty(text_col)).alias("content"))
    base = base.select("id", "content", digest(F.col("content")).alias("digest"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    salted = base.groupBy("digest", "salt", "content").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return salted.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _groups(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(groups with contents, written groups without contents, digests of more than one content or None)."""
    groups = duplicate_groups(docs, id_col, text_col, salts, digest)
    found = written(groups.select("digest", "keep_id", "group_size"))
    collided = found.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
    return groups, found, None if collided.isEmpty() else collided


def _found_by(rows: DataFrame, groups: DataFrame, found: DataFrame, collided: DataFrame | None, content: Column, join) -> DataFrame:
    """`join(rows, groups, keys)` by digest; for digests of more than one content by digest and content."""
    if collided is None:
        return join(rows, found, ["digest"])
    clear = join(rows.join(collided, "digest", "left_anti"), found.join(collided, "digest", "left_anti"), ["digest"])
    mixed = rows.join(collided, "digest", "left_semi").withColumn("content", content)
    return clear.unionByName(join(mixed, groups.join(collided, "digest", "left_semi"), ["digest", "content"]).drop("content"))


def _prepared(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """The columns of `docs` as a struct `row`, with id, digest and a text `key` of the id that is never null."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\x00null"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), key.alias("key"), digest(normalised(text_or_empty(text_col))).alias("digest"))


OUT = ("dedup_digest", "dedup_keep_id", "dedup_group_size", "dedup_kept")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_of) -> DataFrame:
    """All rows and columns of `docs`, plus dedup_digest, dedup_keep_id, dedup_group_size, dedup_kept.

    Null texts count as empty, and empty texts are equal to each other. Very long texts are compared whole. The row with
    the smallest id stays; null ids come last. Where several rows of equal text share the smallest id, exactly one of
    them is marked kept. An empty table gives an empty result. Of the input columns only those with the names of the
    four new ones, in any case, are replaced.
    """
    cols = [c for c in docs.columns if c.lower() not in OUT]
    docs = docs.select(*[F.col(f"`{c}`") for c in cols])
    parts = _groups(docs, id_col, text_col, salts, digest)
    rows = _prepared(docs, id_col, text_col, digest)
    content = normalised(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))
    out = _found_by(rows, *parts, content, lambda r, g, on: r.join(g.select(*on, "keep_id", "group_size"), on))
    # Rows that repeat an id are told apart in a window by id and not by digest, so that Spark can split the join
    # above where a group is large. Rows without an id are dealt by digest.
    spread = Window.partitionBy(F.when(F.col("id").isNull(), F.concat("key", "digest")).otherwise(F.col("key"))).orderBy("digest", "keep_id", "group_size")
    same = [F.lag(c).over(spread).eqNullSafe(F.col(c)) for c in ("digest", "keep_id", "group_size")]
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & ~(same[0] & same[1] & same[2])
    made = dict(zip(OUT, ("digest", "keep_id", "group_size", "kept"), strict=True))
    return out.withColumn("kept", kept).select(*[F.col(f"row.`{c}`").alias(c) for c in cols], *[F.col(c).alias(name) for name, c in made.items()])


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256_of) -> DataFrame:
    """The rows that mark_duplicates() marks as kept, with the columns of `docs`.

    Rows are joined to the groups by digest and kept id together, so no group, however large, meets in one task.
    """
    parts = _groups(docs, id_col, text_col, salts, digest)
    rows, cols = _prepared(docs, id_col, text_col, digest), docs.columns
    content = normalised(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")))

    def join(r: DataFrame, g: DataFrame, on: list[str]) -> DataFrame:
        first = g.select(*on, F.coalesce(F.col("keep_id").cast("string"), F.lit("\x00null")).alias("key"))
        one = Window.partitionBy("key", *on).orderBy("key")
        return r.join(first, ["key", *on]).withColumn("n", F.row_number().over(one)).filter("n = 1").drop("n")

    return _found_by(rows, *parts, content, join).select(*[F.col(f"row.`{c}`").alias(c) for c in cols])
