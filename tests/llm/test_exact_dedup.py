import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forumlens.llm import exact_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("dedup_kept", T.StringType())])


def corpus():
    rnd = random.Random(12)
    texts = [None, "", " ", "a b", "a  b", "a\nb", "a b", "A b", "é", "z" * 100_000] + [f"t{k}" for k in range(40)]
    rows = [(k, rnd.choice(texts), "x") for k in range(600)] + [(1000 + k, "hot\tcopy" if k % 2 else "hot copy", "x") for k in range(400)]
    return rows + [(5, "same row", None), (5, "same row", None), (None, "same row", None), (None, "only null", None), (None, "only null", None)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_groups_match_brute_force(spark, digest):
    """With a digest of one hex digit, different texts collide all over; contents decide."""
    rows = corpus()
    groups = defaultdict(list)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = exact_dedup.mark_duplicates(spark.createDataFrame(rows, DOCS), digest=digest).collect()
    want = Counter((i, norm(t), min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)])) for i, t, _ in rows)
    assert Counter((r.doc_id, norm(r.text), r.dedup_keep_id, r.dedup_group_size) for r in out) == want
    kept = [(norm(r.text), r.doc_id) for r in out if r.dedup_kept]
    assert len(kept) == len(groups) and {t for t, _ in kept} == set(groups)
    assert all(i == min((x for x in groups[t] if x is not None), default=None) for t, i in kept)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_of, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_keep_first_and_empty(spark, digest):
    df = spark.createDataFrame(corpus(), DOCS)
    kept = exact_dedup.keep_first(df, digest=digest)
    marked = exact_dedup.mark_duplicates(df).filter("dedup_kept").select("doc_id", "text")
    norm = lambda rs: Counter((r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in rs)
    assert norm(kept.collect()) == norm(marked.collect())
    assert kept.columns == df.columns and kept.count() == len({re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, _ in corpus()})
    assert exact_dedup.keep_first(spark.createDataFrame([], DOCS)).count() == 0
