"""Every operator keeps the columns of its input, whatever their names, and takes ids of other types."""

import public_tokenizers
import pytest

from pyspark.sql import functions as F

from forumlens.llm import divergence, exact_dedup, language, licenses, mixing, packing, quality, secrets, sharding, simhash, spelling, token_counts, topk

PATH = public_tokenizers.path("byte_bpe_50k.json")
NAMES = ["_first", "_part", "part", "rank", "_gone", "gone", "_mix_key", "_mix_first", "_q", "judged", "jump", "_Jump", "dedup_source", "ident", "rate", "n", "g", "h", "of", "Row", "Key", "DIGEST", "content", "salt", "id", "fp", "node", "label", "comp", "words", "secrets_", "piece", "vec", "a.b"]
TEXTS = ["the quick brown fox jumps over the lazy dog", "the quick  brown fox jumps over the lazy dog", "", None, "under the mit license", "password=hunter2xyz", "x " * 50_000]
#: How an operator is called, the columns that it adds, and whether it keeps those of its input.
CALLS = {
    "sharding": (lambda d: sharding.shard_documents(d, 4), True),
    "tokens": (lambda d: token_counts.count_tokens(d, PATH, 10), True),
    "licenses": (licenses.scan_licenses, False),
    "classes": (simhash.near_duplicate_classes, False),
    "near": (simhash.drop_near_duplicates, True),
    "secrets": (secrets.scan_secrets, True),
    "marked": (exact_dedup.mark_duplicates, True),
    "first": (exact_dedup.keep_first, True),
    "packing": (lambda d: packing.pack(d, PATH), False),
    "mixing": (lambda d: mixing.mix(d, epochs=3.0), True),
    "spelling": (lambda d: spelling.spelling_variants(d, min_count=1), False),
    "language": (lambda d: language.identify_held_out(d, lang_col="source"), True),
    "divergence": (lambda d: divergence.source_divergence(d, lang_col="source", source_col="part", min_docs=1), False),
    "quality": (lambda d: quality.classify(d, d.sparkSession.createDataFrame([], "doc_id string, quality int, toxic int")), True),
}


@pytest.mark.parametrize("name", CALLS)
@pytest.mark.parametrize("case", ["lower", "upper"])
def test_names_and_types(spark, name, case):
    call, keeps = CALLS[name]
    names = NAMES if case == "lower" else [c.upper() for c in NAMES]
    rows = [(None if k == 5 else f"id{k}", t, "src", *[f"{c}{k}" for c in names]) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in ["doc_id", "text", "source", *names]))
    out = call(df)
    got = out.collect()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    if keeps:
        assert out.columns[: len(df.columns)] == df.columns
        given = {r[0]: tuple(r) for r in rows}
        assert got and all(tuple(r)[: len(df.columns)] == given[r.doc_id] for r in got)
    else:
        assert got
    empty = call(df.limit(0))
    assert empty.count() == 0 and empty.columns == out.columns


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "x", "y"), (1, [2.0, 1.0], "x", "y")], "vec_id int, embedding array<float>, norm string, UID string")
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.top_k(df, F.col("vec_id") == 0, 5).collect()] == [(0, 1, 1)]
