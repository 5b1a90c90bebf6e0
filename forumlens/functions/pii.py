"""Redaction of personal data, salted ids and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.functions.text import col, first_non_empty

#: Patterns in the order in which they are replaced: an address must go before what looks like a handle in it. Letters
#: of any script and either case count before a match; after an address only those that could be part of it.
PATTERNS = (
    ("EMAIL", r"(?i)(?<![\p{L}\p{N}_])[A-Z0-9_][A-Z0-9._%+-]*@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Z0-9_])"),
    ("PHONE", r"(?<![0-9])(?:\+?61[ -]?|0)[2-478](?:[ -]?[0-9]){8}(?![0-9])"),
    ("HANDLE", r"(?<![\p{L}\p{N}_])@[A-Za-z0-9_.-]+"),
    ("URL", r"(?i)https?://[^\s]+"),
)


def redact(c: Column | str) -> Column:
    out = col(c)
    for name, pattern in PATTERNS:
        out = F.regexp_replace(out, pattern, f"[{name}]")
    return out


def stable_id(c: Column | str, salt: str) -> Column:
    if not salt:
        raise ValueError("a salt is needed")
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), col(c).cast("string")), 256), 1, 24)


def audit(df: DataFrame, id_col: str, text_col: str, rules: tuple[tuple[str, str], ...] = PATTERNS) -> DataFrame:
    """(id, rule, n): how often each rule is matched, where it is."""
    hits = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(text_col), F.lit(p)).cast("bigint").alias("n")) for name, p in rules])
    return df.select(id_col, F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("hit")).select(id_col, "hit.rule", "hit.n")


def public_record(
    df: DataFrame, salt: str, id_col: str, text_col: str, title_col: str | None = None, platform_col: str | None = None, keep: tuple[str, ...] = (), fall_back: bool = True
) -> DataFrame:
    """A salted id, platform, redacted title and text, and the columns to keep: nothing else leaves.

    The text falls back to the title, the id to the text and the platform to "unknown"; without `fall_back` null stays null
    and empty stays empty. Lengths are cut to 64, 500 and 10000 characters.
    """
    title, platform = (F.col(c) if c else F.lit(None).cast("string") for c in (title_col, platform_col))
    ident, text = F.col(id_col).cast("string"), F.col(text_col)
    if fall_back:
        title = F.coalesce(title, F.lit(""))
        text = F.coalesce(first_non_empty(text, title), F.lit(""))
        ident = F.coalesce(first_non_empty(ident), redact(text))
        platform = F.coalesce(first_non_empty(platform), F.lit("unknown"))
    return df.select(stable_id(ident, salt).alias("public_id"), F.substring(platform, 1, 64).alias("platform"), F.substring(redact(title), 1, 500).alias("title"), F.substring(redact(text), 1, 10000).alias("text"), *keep)
