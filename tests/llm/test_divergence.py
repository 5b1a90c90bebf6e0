import random
import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from forumlens.llm import divergence


def brute(rows, min_docs, top):
    terms = lambda t: ["".join(c.lower() if c < "\x80" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    groups, docs, n, lang_n = defaultdict(set), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang].add(source)
        docs[lang].update(set(found))
        n[lang, source].update(found)
        lang_n[lang].update(found)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(lang_n[lang]), {s: shares(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])}
    return out


def corpus(seed=8):
    rnd = random.Random(seed)
    words = [f"w{chr(97 + k)}" for k in range(26)] + ["Ünï", "Été", "été", "日本", "\U00010400x", "A", "a"]
    rows = []
    for _ in range(600):
        lang, source = rnd.choice(["x", "x", "x", "y", None]), rnd.choice(["hot", "hot", "hot", "s1", "s2", None, "É"])
        text = rnd.choice([" ", ",", "1", "[", "\n"]).join(rnd.choice(words[: rnd.randint(1, len(words))]) for _ in range(rnd.randint(0, 30)))
        rows.append((text, lang, source))
    return rows + [(None, "x", "no text"), ("", "z", "a"), ("only one", "z", "b"), ("1 2", "z", ""), ("7", "lone", "s"), rows[0], rows[0], ("wa wb " * 30_000, "x", "s1")]


@pytest.mark.parametrize("min_docs, top, parts", [(30, 50, 64), (1, 3, 5), (10_000, 50, 64)])
def test_against_brute_force(spark, min_docs, top, parts):
    """From all terms kept to none, with fewer parts than terms and more."""
    df = spark.createDataFrame([(t, lang, s, "x", 1) for t, lang, s in corpus()], "text string, lang string, source string, term string, Value int")
    out = divergence.source_divergence(df, min_docs=min_docs, top=top, parts=parts).collect()
    got = {tuple(r) for r in out}
    assert len(got) == len(out) and got == brute(corpus(), min_docs, top)


def test_values_that_exceed_a_long(spark):
    """A count of 10^12 times the whole needs more than 64 bits."""
    df = spark.createDataFrame([(10**12, 3 * 10**12, 7)], "n long, total long, kept long")
    assert df.select(divergence.share("n", "total", "kept")).first()[0] == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 35)


def test_many_sources(spark):
    rows = [("same words here", "x", f"s{k}") for k in range(60)]
    out = divergence.source_divergence(spark.createDataFrame(rows, "text string, lang string, source string")).filter("part = 'pair'").collect()
    assert len(out) == 60 * 59 and {r.value for r in out} == {0} and {(r.source, r.item) for r in out} == {(a, b) for a, b in product({r[2] for r in rows}, repeat=2) if a != b}


def test_empty(spark):
    out = divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string"))
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]
