"""License scans by diagonal voting, with DataFrame operations only.

The rolling k-word hashes of all texts are joined to the positions of the same hashes in license templates. A match at
word p of a text and word q of a template votes for the diagonal p - q; votes are compared word by word, so that a
collision of hashes counts nothing. Neighbouring diagonals of a template, as insertions and deletions make them, are
merged, and the merged span is verified by the share of the template's words that its matches cover.

Phrases are templates of two-word runs that must be covered whole, each diagonal being one place; license texts are
templates of five-word runs of which a given share must be covered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.llm.shared import text_or_empty

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of public license texts, by the label that the method adds.
TEXTS = {
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words in a run of a phrase and of a text.
SHORT, LONG = 2, 5
#: Share of a text's words that must be covered, and words that neighbouring diagonals may be apart.
SHARE, APART = 0.5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z in lower case.

    lower() also changes letters beyond ASCII, which no template holds; only two of them become ASCII letters, and
    texts with those take the slower translate().
    """
    lowered = F.when(text.rlike("[İK]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def template_rows(phrases: dict[str, str], texts: dict[str, str]) -> list[tuple]:
    """(template, label, whole, k, size, position, run) of every run of every template."""
    rows = []
    for k, whole, found in ((SHORT, True, phrases.items()), (LONG, False, [(t, label) for label, t in texts.items()])):
        for text, label in found:
            words = template_words(text)
            if len(words) < k:
                raise ValueError(f"a template needs at least {k} words: {text!r}")
            rows += [(len(rows), text, label, whole, k, len(words), q, words[q : q + k]) for q in range(len(words) - k + 1)]
    names = {t: n for n, t in enumerate(dict.fromkeys((r[1], r[3]) for r in rows))}
    return [(names[r[1], r[3]], *r[2:]) for r in rows]


RUNS = T.StructType(
    [T.StructField(n, t) for n, t in (("template", T.IntegerType()), ("label", T.StringType()), ("whole", T.BooleanType()), ("k", T.IntegerType()), ("size", T.IntegerType()), ("q", T.IntegerType()), ("run", T.ArrayType(T.StringType())))]
)


def _rolling(words: Column, k: int) -> Column:
    """The hash of the k words from each place on; at the end, where words are missing, no template's hash."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS, share: float = SHARE) -> DataFrame:
    """One row per row of `docs`: id, n_words, spans, and what is derived from the spans.

    spans: (label, whole, start, end, cover) in words; n_base, first_word, last_word and base_labels are of phrases,
    labels are of all spans, score is the best cover of any span, or 0. Null and empty texts have no words; very long
    texts are scanned whole. Spans are ordered by label and then by place, and equal covers all count, so that ties need
    no choice. Rows that repeat come out as often as they come in, and ids may be of any type. Other columns are not
    read, so that their names cannot clash. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    runs = spark.createDataFrame(template_rows(phrases, texts), RUNS)
    runs = runs.withColumn("h", F.xxhash64(*[F.get("run", F.lit(j)) for j in range(LONG)]))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), words_of(text_or_empty(text_col)).alias("words"))
    # The first element stands for the text itself, which must not be lost if nothing matches. The outer form keeps
    # Spark from testing beforehand that there are elements, by making them twice.
    keys = F.concat(F.array(F.lit(0).cast("long")), _rolling(F.col("words"), SHORT), _rolling(F.col("words"), LONG))
    grams = base.withColumn("keys", keys).withColumn("n_words", F.size("words")).select("row", "id", "n_words", "words", F.posexplode_outer("keys").alias("at", "h"))
    # The templates are a constant of this module's size, and so fit to be broadcast.
    hits = grams.join(F.broadcast(runs), "h", "left").filter("at = 0 or template is not null")
    p = F.when(F.col("at") <= F.col("n_words"), F.col("at") - 1).otherwise(F.col("at") - 1 - F.col("n_words"))
    hits = hits.withColumn("p", p).filter("at = 0 or slice(words, p + 1, k) = run")
    hits = hits.select("row", "id", "n_words", *[F.when(F.col("at") > 0, F.col(c)).alias(c) for c in ("template", "label", "whole", "k", "size", "q", "p")])
    hits = hits.repartition("row")
    key = ["row", "id", "n_words", "template", "label", "whole", "k", "size"]
    diagonals = hits.withColumn("d", F.col("p") - F.col("q")).groupBy(*key, "d").agg(F.collect_set("q").alias("qs"), F.min("p").alias("start"), F.max(F.col("p") + F.col("k")).alias("end"))
    by = Window.partitionBy("row", "template").orderBy("d")
    new = F.col("whole") | F.lag("d").over(by).isNull() | (F.col("d") - F.lag("d").over(by) > APART)
    diagonals = diagonals.withColumn("new", new.cast("int"))
    diagonals = diagonals.withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    merged = diagonals.groupBy(*key, "span").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"), F.min("start").alias("start"), F.max("end").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    merged = merged.withColumn("cover", F.when(F.col("template").isNotNull(), covered / F.col("size")))
    good = F.when(F.col("whole"), F.col("cover") == 1).otherwise(F.col("cover") >= share)
    span = F.when(good, F.struct("label", "whole", "start", "end", "cover"))
    out = merged.groupBy("row", "id", "n_words").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    phrase = F.filter("spans", lambda s: s["whole"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda s: s["label"]))), ",")
    return out.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), F.size(phrase).cast("long").alias("n_base"),
        F.array_min(F.transform(phrase, lambda s: s["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(phrase, lambda s: s["start"])).cast("long").alias("last_word"),
        names(phrase).alias("base_labels"), names("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"), "spans",
    )
