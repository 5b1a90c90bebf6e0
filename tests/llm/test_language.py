import random
import re
import zlib
from collections import Counter

import pytest

from forumlens.llm import language

WORDS = {
    "aa": "the of and water people which their about many these",
    "bb": "der die und nicht auch werden zwischen über möglich straße",
    "cc": "и в не что она только время большой чтобы человек",
    "dd": "的 一 是 不 了 人 我 在 有 他",
}


def corpus(seed=4, n=240):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(WORDS))
        text = " ".join(rnd.choice(WORDS[lang].split()) + rnd.choice(["", ",", " 12", "…\n"]) for _ in range(rnd.randint(3, 60)))
        rows.append((i, rnd.choice([str.upper, str.lower, str])(text), None if rnd.random() < 0.1 else lang))
    return rows + [(None, "the water", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "12 -- 7", "cc"), (903, "x", "dd"), (5, rows[5][1], rows[5][2])]


def plain(rows, ranks=language.RANKS):
    """Strings and counters instead of numbers and arrays."""

    def grams(text):
        t = re.sub(r"[\W\d_]+", " ", text.lower()) if text else ""
        t = f" {t.strip()} "
        return Counter(g for k in (1, 2, 3) for g in (t[i : i + k] for i in range(len(t) - k + 1)) if g != " ") if t.strip() else Counter()

    def rank(c):
        return {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], len(g), g))[:ranks])}

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    langs: dict[str, Counter] = {}
    for i, t, lang in rows:
        if not held(i) and lang is not None and t is not None:
            langs.setdefault(lang, Counter()).update(grams(t))
    profiles = {lang: rank(c) for lang, c in langs.items() if c}
    out = []
    for i, t, _ in rows:
        own = rank(grams(t))
        far = {lang: sum(abs(k - p[g]) if g in p else ranks for g, k in own.items()) for lang, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k)) if own and far else "und"
        out.append((i, held(i), best, 1 - far[best] / (len(own) * ranks) if best in far else 0.0))
    return Counter(out)


@pytest.mark.parametrize("ranks", [language.RANKS, 12])
def test_against_plain_counters(spark, ranks):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id int, text string, lang string, Held_Out string, gram string")
    out = language.identify_held_out(df, ranks=ranks)
    assert out.columns == ["doc_id", "text", "lang", "gram", "lang_pred", "lang_score", "held_out"]
    got = Counter((r.doc_id, r.held_out, r.lang_pred, r.lang_score) for r in out.collect())
    assert got == plain(rows, ranks)


def test_pieces_count_as_the_whole(monkeypatch):
    text = "".join(random.Random(6).choice("ab é.7") for _ in range(700)) + "..."
    whole = [x.tolist() for x in language.count_grams(text)]
    for piece in (1, 2, 3, 7, 699, 703):
        monkeypatch.setattr(language, "PIECE", piece)
        assert [x.tolist() for x in language.count_grams(text)] == whole


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    told = [(r.lang, r.lang_pred) for r in language.identify_held_out(docs.select("doc_id", "text", "lang")).filter("held_out").select("lang", "lang_pred").collect()]
    right = sum(a == b for a, b in told) / len(told)
    print(f"{sf}: {right:.4f} of {len(told)}")
    assert len(told) > 300 and right >= 0.97


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id int, text string, lang string")
    assert [(r.lang_pred, r.lang_score) for r in language.identify_held_out(df).collect()] == [("und", 0.0)]
    assert language.identify_held_out(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="languages"):
        language.fit_profiles(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, lang string"), max_langs=1)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "und auch " * 400_000 + "the", "bb"), (3, "the of and", "aa"), (2, "der werden", "bb")], "doc_id int, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.identify(df, language.fit_profiles(df.select("text", "lang"))).collect()} == {1: "bb", 2: "bb", 3: "aa"}
