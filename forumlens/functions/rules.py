"""First-match rule cascades and lookups; the rules are arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumlens.functions.text import col, first_non_empty

Rules = list[tuple[str, str]]  # (label, regular expression), in order of priority


def first_match(c: Column | str, rules: Rules, default: str | None = None) -> Column:
    """The label of the first rule that the lower-cased text matches. Rules after it are not tried."""
    s = F.lower(F.coalesce(col(c), F.lit("")))
    out = None
    for label, pattern in rules:
        out = F.when(s.rlike(pattern), label) if out is None else out.when(s.rlike(pattern), label)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def infer_subtopic(keyword: Column | str, content: Column | str, rules: Rules, default: str = "general") -> Column:
    """The search keyword is tested by all rules before the content is."""
    return F.coalesce(first_match(keyword, rules), first_match(content, rules), F.lit(default))


def contains_cascade(c: Column | str, tokens: list[tuple[str, str]], default: str) -> Column:
    """The label of the first token that the lower-cased text contains."""
    s, out = F.lower(F.coalesce(col(c), F.lit(""))), None
    for token, label in tokens:
        out = F.when(s.contains(token), label) if out is None else out.when(s.contains(token), label)
    return F.lit(default) if out is None else out.otherwise(default)


#: Texts that stand for a missing value.
NULL_LIKE = ("nan", "none", "null", "nat", "")


def clean_value(c: Column | str) -> Column:
    """Trimmed text; null for what only says that a value is missing."""
    s = F.trim(col(c))
    return F.when(~F.lower(s).isin(*NULL_LIKE), s)


def non_null_entries(m: Column | str) -> Column:
    """The entries of a map of texts whose value is there, trimmed."""
    return F.map_filter(F.transform_values(col(m), lambda _, v: clean_value(v)), lambda _, v: v.isNotNull())


def numeric_entries(m: Column | str) -> Column:
    """How many values of a map of texts are numbers, after thousands' commas are dropped."""
    return F.size(F.filter(F.map_values(col(m)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double").isNotNull()))


def row_label(m: Column | str, preferred: list[str]) -> Column:
    """The value of the first preferred key that is there, else the first value that is no number."""
    words = F.filter(F.map_values(col(m)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double").isNull())
    return F.coalesce(*[first_non_empty(F.try_element_at(col(m), F.lit(k))) for k in preferred], F.get(words, F.lit(0)))


def row_type(m: Column | str, note: str, header: str) -> Column:
    """'note' or 'header' by markers in the values, notes first; else 'data' if a number is there, else 'text'."""
    values = F.map_values(col(m))
    has = lambda shape: F.exists(values, lambda v: F.lower(v).rlike(shape))
    return F.when(has(note), "note").when(has(header), "header").when(numeric_entries(m) > 0, "data").otherwise("text")


def row_text(m: Column | str, most: int = 80) -> Column:
    """The first `most` entries as 'key: value', joined by bars, in order of keys."""
    entries = F.array_sort(F.map_entries(col(m)))
    return F.array_join(F.slice(F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), 1, most), " | ")


def source_group(c: Column | str) -> Column:
    """The first folder of a path; 'manifest' for manifests; else 'unknown'."""
    s = col(c)
    return F.when(s.contains("/"), F.split_part(s, F.lit("/"), F.lit(1))).when(F.lower(s).contains("manifest"), "manifest").otherwise("unknown")


def relevant(c: Column | str, words: list[str], phrases: list[str]) -> Column:
    """Any word as a whole word, or any phrase anywhere, in the lower-cased text."""
    s = F.lower(F.coalesce(col(c), F.lit("")))
    # Borders are written out: letters of any script are part of a word.
    out = s.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}_])") if words else F.lit(False)
    for p in phrases:
        out = out | s.contains(p)
    return out


def regions_in_text(c: Column | str, aliases: dict[str, str]) -> Column:
    """The distinct codes whose alias stands in the text as a word of its own, longest aliases first."""
    s = F.lower(F.coalesce(col(c), F.lit("")))
    order = sorted(aliases.items(), key=lambda a: (-len(a[0]), a[0]))
    hits = F.array(*[F.when(s.rlike(f"(^|[^a-z]){alias}([^a-z]|$)"), code) for alias, code in order])
    return F.array_distinct(F.array_compact(hits))


def place_context(c: Column | str, cities: list[tuple[str, str, str]], states: Rules, country: str, named: tuple[str, str], other: str = "Other") -> Column:
    """A struct (label, type, city, state) of a free text about a place; null for what only says that a value is missing.

    cities: (city, its state, expression), which all come before states: (state, expression), and these before the country,
    which `named` gives a label and a state. Expressions match whole words of the lower-cased text; the first match wins.
    """
    s = F.lower(clean_value(c))
    told = lambda label, kind, city, state: F.struct(F.lit(label).alias("label"), F.lit(kind).alias("type"), F.lit(city).cast("string").alias("city"), F.lit(state).alias("state"))
    whole = lambda pattern: s.rlike(rf"(?<![a-z0-9_])(?:{pattern})(?![a-z0-9_])")
    out = F.when(s.isNull(), F.lit(None))
    for city, state, pattern in cities:
        out = out.when(whole(pattern), told(city, "city", city, state))
    for state, pattern in states:
        out = out.when(whole(pattern), told(state, "state", None, state))
    return out.when(whole(country), told(named[0], "country", None, named[1])).otherwise(told(other, "other", None, "unknown"))


def relevant_post(content: Column | str, bio: Column | str, handle: Column | str, words: list[str], phrases: list[str], signs: tuple[str, ...] = ()) -> Column:
    """relevant() of a post with its author's description and handle; signs, such as a flag of two code points, stand anywhere."""
    blob = F.concat_ws(" ", col(content), col(bio), col(handle))
    return relevant(blob, words, [*phrases, *signs])
