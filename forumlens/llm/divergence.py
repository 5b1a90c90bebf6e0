"""How far the words of each source of a language stray from those of its other sources, with DataFrame operations only.

Words are exploded and counted by language, source and term. The groups of a language are crossed with the vocabulary
that the language keeps, so that a term that a source lacks counts as zero; the shares are joined with themselves by
language and term, their differences summed for each pair of sources, and ranked. A hot source is counted in part by each
task before it is shuffled, and the cross is dealt by term, so that no task holds a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forumlens.llm.shared import lower_ascii, scratch, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term must be in to be kept.
MIN_DOCS = 30
#: Added to each count, and the whole that shares are parts of.
SMOOTHING, WHOLE = 5, 1_000_000_000
#: Terms that are reported for a group.
TOP = 50
#: Parts into which the vocabulary of a language is dealt to meet the language's groups.
PARTS = 64


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term.

    A document without terms gives its group a row with a null term. A document's terms are sorted in its own row, where the
    first of equal ones tells that the document holds the term.
    """
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    base = docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))
    base = base.select("lang", "source", F.sort_array(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))).alias("terms"))
    each = base.select("lang", "source", "terms", F.posexplode_outer("terms").alias("at", "term"))
    first = F.col("term").isNotNull() & ~F.col("term").eqNullSafe(F.get("terms", F.col("at") - 1))
    return each.select("lang", "source", "term", first.cast("long").alias("first")).groupBy("lang", "source", "term").agg(F.count("term").alias("n"), F.sum("first").alias("docs"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(WHOLE * (count + SMOOTHING) / (total + SMOOTHING * kept)), whose product would not fit a long."""
    return F.expr(f"1 + cast({WHOLE} * cast({count} + {SMOOTHING} as decimal(20, 0)) as decimal(38, 0)) div cast({total} + {SMOOTHING} * {kept} as decimal(20, 0))")


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """(lang, source, part, item, value, rank), of two parts for every language and source that occur together.

    `pair`: a row for each other source of the language, all of them ranked, with the sum over the kept terms of the
    difference of the two shares, which is 0 where the language keeps no term. `term`: the at most `top` terms that the
    source holds, and more often than its language does as a whole, with the difference. Ranks are from 1, by value
    descending and then by item in UTF-8 order, so that there are no ties. Null text, language and source count as empty
    strings; very long texts are read whole; repeated rows count each; an empty table gives an empty result. Other
    columns are not read, so that their names cannot clash.
    """
    with scratch(docs.sparkSession) as keep:
        counts = written(term_counts(docs, text_col, lang_col, source_col))
        groups = counts.select("lang", "source").distinct()
        totals = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = written(totals.filter(F.col("docs") >= min_docs).select("lang", "term", "lang_n"))
        sizes = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("kept"))
        held = written(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"))
        groups = groups.join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
        spread = groups.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = kept.join(sizes, "lang").withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
        cells = dealt.join(spread, ["lang", "deal"]).join(held, ["lang", "source", "term"], "left").na.fill(0, ["n"])
        cells = written(cells.select("lang", "source", "term", "n", share("n", "total", "kept").alias("p"), share("lang_n", "lang_total", "kept").alias("q")))

        ours, theirs = cells.select("lang", "term", "source", "p"), cells.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other"))
        pairs = ours.join(theirs, ["lang", "term"]).filter("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("other"))).alias("value"))
        # Languages that keep no term have no cells; their pairs are of groups alone.
        bare = groups.join(sizes, "lang", "left_anti").select("lang", "source")
        pairs = pairs.union(bare.join(bare.withColumnRenamed("source", "item"), "lang").filter("source < item").withColumn("value", F.lit(0).cast("long")).select("lang", "source", "item", "value"))
        ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
        pairs = pairs.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(order))
        terms = cells.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        return keep(pairs.union(terms))
