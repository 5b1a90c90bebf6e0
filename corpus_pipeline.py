"""From raw documents to packed training sequences: five stages, each by one operator of forumlens.llm.

Every stage works on all that its predecessor kept; its result is written as Parquet and read again, and goes when the
next one is written. All stages but the last return the columns of `documents`.

1. quality: documents that the weak-label classifier rejects, as junk or as toxic, go. Keywords of two of its labellers
   are mined from a bounded sample of the table `labels`, whose labels never vote.
2. exact_dedup: of texts that are equal but for runs of white space the row with the smallest id stays.
3. near_dedup: of each component of texts whose five-word shingles have a similarity of 0.8 or more one stays.
4. mixing: sources are brought to shares in proportion to their size to the power 0.7, by Poisson replication, so a
   document may come out several times or not at all.
5. packing: documents are packed into sequences of at most 1024 tokens.

What holds for all stages: null texts count as empty, and empty ones are kept by quality and near_dedup, of which
exact_dedup leaves one; very long texts are read whole; of equal rows exact_dedup leaves one; ties go to the smaller
id, and null ids come last; further columns of any name pass through all stages but the last; an empty table gives
an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from forumlens.llm import exact_dedup, mixing, packing, quality, simhash
from forumlens.session import fresh_dir, remove, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are neither junk nor toxic. An empty or null text has no fault and stays; so does a repeated row."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter("quality_kept").select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text. Null and empty texts are one; of rows that share text and id exactly one stays."""
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One id of each component of similar texts, the smallest. Rows without an id or without words stay."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as drawn. A null source is one of its own, and null ids draw alike."""
    return mixing.mix(docs, alpha=0.7, epochs=1.0, seed="mix").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece with its sequence and place; an empty text is one piece of the end id. Repeated rows are all packed."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express tokens, hashes of shingles or a fitted classifier; tests/llm/test_pipeline.py checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = fresh_dir(spark, "stage")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if old:
            remove(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)
