"""Scalar text functions as Column expressions; all run inside the JVM unless they say otherwise."""

from __future__ import annotations

import html
import re
from html import entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[ \t\n\r\f\x0B]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def non_empty(c: Column | str) -> Column:
    """Null for empty text: what `or` chains take as missing."""
    return F.nullif(col(c), F.lit(""))


def first_non_empty(*cs: Column | str) -> Column:
    return F.coalesce(*[non_empty(c) for c in cs])


def tokenize(c: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def snippet(c: Column | str, length: int = 240) -> Column:
    """White space collapsed; if longer than `length`, cut to one less and marked with an ellipsis."""
    s = squeeze(c)
    return F.when(F.length(s) <= length, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, length - 1)), F.lit("…")))


#: The named entities that occur most in pages; decode_all() knows the whole table.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))


def decode_entities(c: Column | str) -> Column:
    """The entities of ENTITIES, `&amp;` last so that nothing is decoded twice."""
    out = col(c)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


#: A reference with its semicolon, by number or by name.
CLOSED = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decode_all(c: Column | str, closed: bool = False) -> Column:
    """Every HTML entity, by the standard table: a pandas UDF, for data that decode_entities() does not cover.

    Browsers also take some names without a semicolon, as in a text that is cut within one; `closed` leaves these as they are.
    """

    def closed_one(m: re.Match) -> str:
        return html.unescape(m[0]) if m[0][1] == "#" else entities.html5.get(m[0][1:], m[0])

    @F.pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        return s.map((lambda x: CLOSED.sub(closed_one, x)) if closed else html.unescape, na_action="ignore")

    return decode(col(c))


def strip_html(c: Column | str, full: bool = False) -> Column:
    """Tags become spaces, entities are decoded, white space collapses."""
    bare = F.regexp_replace(col(c), "<[^>]+>", " ")
    return squeeze(decode_all(bare) if full else decode_entities(bare))


def safe_doc_id(c: Column | str, prefix: str, limit: int = 160, keep: int = 120) -> Column:
    """An id of [A-Za-z0-9._-] after a prefix; a long one is cut and told apart by a digest of the raw value."""
    raw = F.trim(F.coalesce(col(c), F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, SPACE, "_"), "[/:]", "_"), "[^A-Za-z0-9._-]", "_")
    short = F.when(F.length(clean) > limit, F.concat(F.substring(clean, 1, keep), F.lit("_"), F.substring(F.sha1(raw), 1, 16))).otherwise(clean)
    return F.concat(F.lit(f"{prefix}_"), F.when(raw == "", F.lit("missing_id")).otherwise(short))


def stable_hash(fields: dict[str, Column | str]) -> Column:
    """16 hex digits of the SHA-1 of the fields, in the order of their names; null differs from empty."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(F.concat(F.lit("s:"), col(fields[k]).cast("string")), F.lit("n"))) for k in sorted(fields)]
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16)


def clean_social(c: Column | str) -> Column:
    """Without links and mentions, hash signs dropped, other characters than letters, digits and .,!?$%'- as spaces."""
    s = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"https?://[^ \t\n\r\f\x0B]+|www\.[^ \t\n\r\f\x0B]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"@[\p{L}\p{N}_]+", " "), "#", "")
    return squeeze(F.regexp_replace(s, r"[^A-Za-z0-9 .,!?$%'\-]", " "))


def cloud_words(c: Column | str, stopwords: list[str]) -> Column:
    """Words of a word cloud: three letters or more, possessives and plurals folded, stopwords dropped."""
    raw = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"[A-Za-z][A-Za-z'\-]{2,}"), F.lit(0))

    def fold(w: Column) -> Column:
        w = F.regexp_replace(F.lower(w), r"^['\-]+|['\-]+$", "")
        w = F.regexp_replace(w, "'s$", "")
        long = F.length(w) > 4
        return (
            F.when(long & w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
            .when(long & w.endswith("s"), F.regexp_replace(w, "s$", ""))
            .otherwise(w)
        )

    return F.filter(F.transform(raw, fold), lambda w: (F.length(w) >= 3) & ~w.isin(*stopwords) if stopwords else F.length(w) >= 3)


def humanise_code(c: Column | str, names: dict[str, str] | None = None) -> Column:
    """A code's name from a table; else its parts that are longer than two and no numbers; else the text itself."""
    s = F.trim(col(c))
    parts = F.filter(F.split(s, "_"), lambda p: (F.length(p) > 2) & ~p.rlike("^[0-9]+$"))
    words = F.lower(F.array_join(parts, " "))
    out = F.when(s.rlike("^[A-Z0-9_]+$") & s.contains("_") & (F.size(parts) > 0), words).otherwise(s)
    if names:
        out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), s), out)
    return out


def to_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))
