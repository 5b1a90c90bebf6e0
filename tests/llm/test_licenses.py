import random
import re

from pyspark.sql import types as T

from forumlens.llm import licenses

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("template", T.StringType())])


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark):
    rnd = random.Random(4)
    atoms = ["MIT", "mit", "License", "license", "Apache", "general", "Public", "general public", "é", "word", "-", ".", "\n", "general public license", "mit license", "K", "lİcense", "MıT"]
    texts = [rnd.choice([" ", "-", "\n"]).join(rnd.choices(atoms, k=rnd.randint(0, 25))) for _ in range(300)]
    texts += ["", None, "mit license " * 2000, "GENERAL\tPUBLIC\rLICENSE", texts[0]]
    df = spark.createDataFrame([(k % 50, t, "clash") for k, t in enumerate(texts)] + [(None, "mit license", None)], DOCS)
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(df).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted([(k % 50, *brute(t)) for k, t in enumerate(texts)] + [(None, *brute("mit license"))], key=key)
    assert licenses.scan_licenses(spark.createDataFrame([], DOCS)).count() == 0


def test_edited_texts_are_found_over_neighbouring_diagonals(spark):
    mit = licenses.template_words(licenses.TEXTS["mit-text"])
    edited = mit[:30] + ["inserted"] + mit[30:55] + mit[57:]
    half = mit[: len(mit) // 3]
    rows = [(1, " ".join(["lead"] * 7 + edited + ["tail"]), None), (2, " ".join(half), None), (3, licenses.TEXTS["bsd-text"], None), (4, " ".join(mit + ["gap"] * 40 + mit), None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].labels == "mit-text" and 0.85 < got[1].score < 1
    (span,) = got[1].spans
    assert (span.start, span.end) == (7, 7 + len(edited))
    assert got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "bsd-text" and got[3].score == 1
    assert [s.label for s in got[4].spans] == ["mit-text"] * 2
