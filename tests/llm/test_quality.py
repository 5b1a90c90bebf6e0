import random

import numpy as np
from pyspark.sql import types as T

from forumlens.llm import quality

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("junk_score", T.StringType())])
LABELS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("doc_id", "quality", "toxic")])


def corpus(n=600):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(2000)] + ["the", "of", "and"] * 150
    rows, truth = [], {}
    for k in range(n):
        text = " ".join(rnd.choices(words, k=rnd.randint(30, 200))) + "."
        kind = rnd.random()
        if kind < 0.1:
            text = " ".join([rnd.choice(words)] * 80)
        elif kind < 0.2:
            text = " ".join(w + "###" for w in text.split())
        elif kind < 0.3:
            text = text.replace(" ", " idiot ", 3)
        truth[k] = (int(kind >= 0.2), int(0.2 <= kind < 0.3))
        rows.append((k, text, "clash"))
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    shown = [(k, *truth[k]) for k in truth if k % 3 == 0]
    out = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame(shown, LABELS)).collect()
    held = [r for r in out if r.doc_id % 3]
    right = [r.quality_kept == (truth[r.doc_id] == (1, 0)) for r in held]
    assert np.mean(right) > 0.97
    assert all(r.quality_kept for r in held if truth[r.doc_id] == (1, 0))


def test_without_labels_the_heuristics_do(spark):
    rows, truth = corpus()
    out = quality.classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS)).collect()
    assert np.mean([r.quality_kept == (truth[r.doc_id] == (1, 0)) for r in out]) > 0.9


def test_em_finds_the_reliable_labeller():
    rnd = random.Random(7)
    counts = {}
    for _ in range(5000):
        bad = rnd.random() < 0.3
        vote = lambda p, bad=bad: "bg"[(rnd.random() > p) == bad]
        p = vote(0.95) + vote(0.9) + vote(0.6) + (vote(1.0) if rnd.random() < 0.3 else "-")
        counts[p] = counts.get(p, 0) + 1
    post, share, rates = quality.posteriors(counts)
    assert abs(share - 0.3) < 0.03
    assert abs(rates[0]["bad"] - 0.95) < 0.03 and abs(rates[2]["bad"] - 0.6) < 0.05
    assert quality.posteriors({}) == ({}, 0.5, [])


def test_edges(spark):
    rows, truth = corpus(60)
    rows += [(None, None, None), (900, "", None), (901, "Short.", None), (5, rows[5][1], None), (902, "word " * 60_000, None)]
    labels = spark.createDataFrame([(k, *truth[k]) for k in truth] + [(None, 0, 1), (0, None, None)], LABELS)
    out = quality.classify(spark.createDataFrame(rows, DOCS), labels).collect()
    assert len(out) == len(rows)
    assert all(r.quality_kept for r in out if r.doc_id in (None, 900, 901))
    assert len({r.junk_score for r in out if r.doc_id == 5}) == 1
    assert quality.classify(spark.createDataFrame([], DOCS), labels).count() == 0


def test_length_alone_is_no_fault(spark):
    rows, truth = corpus()
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(60_000)]
    share = [1 / (k + 3) for k in range(len(words))]
    prose = lambda n: ". ".join(" ".join(rnd.choices(words, share, k=25)) for _ in range(n // 25))
    shown = spark.createDataFrame([(k, *truth[k]) for k in truth], LABELS)
    long = [(1000 + k, prose(n), None) for k, n in enumerate((50_000, 100_000, 500_000))]
    page = prose(1500)
    # A page over and over, and a long text that is one word in the main, are junk still; so is one insult of many pages.
    bad = [(2000, " ".join([page] * 40), None), (2001, ("word " * 30 + "\n") * 3000, None), (2002, prose(20_000) + " idiot" * 3 + " " + prose(20_000), None)]
    out = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows + long + bad, DOCS), shown).collect()}
    for k, text, _ in long:
        assert out[k].quality_kept and "b" not in out[k].quality_votes, (k, out[k].quality_votes, out[k].junk_score, out[k].toxic_score)
    assert not any(out[k].quality_kept for k, _, _ in bad)


def test_labels_never_vote(spark):
    """With human labels that say the opposite, the heuristic labellers' posteriors are the same."""
    rows, truth = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    fits = [quality.fit(docs, spark.createDataFrame([(k, int(q != flip), 0) for k, (q, _) in truth.items()], LABELS)) for flip in (False, True)]
    assert fits[0]["faults"] == fits[1]["faults"] and fits[0]["faults"]["noise"]["posteriors"]["bbg"] > 0.9


def test_clashing_names(spark):
    rows, truth = corpus(80)
    df = spark.createDataFrame([(str(k), t, 1, 2, 3) for k, t, _ in rows], "doc_id string, text string, judged int, I int, Junk_Score int")
    labels = spark.createDataFrame([(str(k), *truth[k]) for k in truth], "doc_id string, quality int, toxic int")
    out = quality.classify(df, labels)
    assert out.columns == ["doc_id", "text", "judged", "I", *quality.OUT] and out.count() == 80


def test_keywords_vote():
    marks = quality.KeyMarks((frozenset({"rubb"}), frozenset()))
    text = "what rubbish and more rubbish of the " * 10
    for _ in range(2):  # with an empty cache, and with a filled one
        assert quality.votes(text, quality.parse(text), marks)["toxic"] == "gb-"
    clean = "what a day and more of the same to come " * 10
    assert quality.votes(clean, quality.parse(clean), marks)["toxic"] == "gg-"


def test_rows_without_ids_are_sampled_like_others(spark):
    """More rows than the sample, none of which has an id: what is rejected does not depend on ids."""
    rows, truth = corpus(3000)
    labels = spark.createDataFrame([], LABELS)
    rejected = []
    for given in (rows, [(None, t, c) for _, t, c in rows]):
        out = quality.classify(spark.createDataFrame(given, DOCS), labels, sample=400).filter("not quality_kept")
        rejected.append({r.text for r in out.collect()})
    bad = {t for k, t, _ in rows if truth[k] != (1, 0)}
    assert all(len(r & bad) > 0.85 * len(bad) and len(r - bad) < 0.02 * len(rows) for r in rejected)


def test_words_and_weights_are_found_without_all_features():
    """Words of ASCII texts come without the pattern, and the scorer's features without those that no weight is for."""
    texts = ["A_b1\x1cC\x0b d-e's  x\x7fy", "", " \n", "É A_1 ſ İ K", "what rubbish and more RUBBISH of the " * 10 + "#1 $$ ##"]
    for t in texts:
        assert quality.words_of(t) == quality.WORD.findall(t.lower())
    marks = quality.KeyMarks((frozenset({"rubb", "rubbish"}), frozenset({"rubbis", "more"})))
    assert [marks.of(w) for w in ("rubbing", "rubbish", "mor", "more", "bore")] == [1, 3, 0, 2, 0]
    part = quality.parse(texts[-1])[0]
    every = quality.features(part, quality.Hasher())
    some = every[::3].tolist() + [1, -1]
    assert quality.Chosen(some).features(part).tolist() == sorted(set(some) & set(every.tolist()))
    assert quality.Chosen(()).features(part).tolist() == []


def test_fitting_needs_little_memory():
    """Less than the features themselves take twice, as the fit runs in the driver."""
    import tracemalloc

    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(-(1 << 31), 1 << 31, 2000).astype(np.int32)) for _ in range(1000)]
    for r in rows[::2]:
        r[:3] = (1, 2, 3)
    tracemalloc.start()
    names, weights, _ = quality.fit_linear(rows, np.resize([0.9, 0.1], len(rows)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert names.tolist() == [1, 2, 3] and (weights > 0).all()
    assert most < 2 * sum(r.nbytes for r in rows)
