import random

import public_tokenizers
import pytest
from pyspark.sql import types as T

from forumlens.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])


def texts():
    rnd = random.Random(3)
    atoms = ["the", " ", "  ", "\n", "\n\n", " \n", "don't", "it's", "'s", "Überé", "ñ1", "12", "?!", "<|endoftext|>", "\t", " ", "語", "😀", "x" * 50, "_", "³", "K"]
    out = ["".join(rnd.choices(atoms, k=rnd.randint(1, 30))) for _ in range(400)]
    out += [" ".join(rnd.choices(["The", "of,", "(a)", "don't", "é's", "x-1", "ß."], k=20)) + "\nNext 'll line's" for _ in range(50)]
    return out + ["", " ", "\n", "a ", " a", "a\n", "\na", "a \n", "word " * 5000]


@pytest.mark.parametrize("kind", ["len", "ids"])
def test_encoder_is_the_library(kind):
    t = bpe.load(PATH)
    enc = bpe.worker_encoder(PATH, kind)
    for x in texts():
        ids = t.encode(x, add_special_tokens=False).ids
        if kind == "len":
            assert enc.count(x) == len(ids), x
        else:
            assert enc.ids(x) == bpe.ids_bytes(ids), x


def test_other_scripts_are_looked_up_by_pieces(monkeypatch):
    rnd = random.Random(5)
    scripts = ["привет", "мир", "漢字", "かな", "שלום", "مرحبا", "ไทย", "हिन्दी", "naïve", "—", "“quote”", "…", "😀", "e\u0301", "½", "Ⅷ", "\u3000", "\xa0", "\x1c"]
    t = bpe.load(PATH)
    enc = bpe.Encoder(PATH, len)
    want = {}
    for _ in range(300):
        x = "".join(rnd.choices([*scripts, " ", "  ", "\n\n", "\t", "\r\n", "a", "'s", "1"], k=rnd.randint(1, 40)))
        want[x] = len(t.encode(x, add_special_tokens=False).ids)
    seen = []
    whole = bpe.Encoder.whole
    monkeypatch.setattr(bpe.Encoder, "whole", lambda self, x: seen.append(x) or whole(self, x))
    assert all(enc.count(x) == n for x, n in want.items())
    assert not set(seen) & {x for x in want if len(enc.split(x)) > 1}


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    enc = bpe.Encoder(PATH, len, {" of": 1})
    t = bpe.load(PATH)
    for x in ["a of b", "cc of dd ee", "ff gg hh of"]:
        assert enc.count(x) == len(t.encode(x, add_special_tokens=False).ids)
    assert len(enc.pieces) <= 5 and enc.pieces[" of"] == 1


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 50)
    rows = [(k, x, "old") for k, x in enumerate(texts())] + [(None, None, None), (1, "twice", None), (1, "twice", None)]
    t = bpe.load(PATH)
    out = token_counts.count_tokens(spark.createDataFrame(rows, DOCS), PATH, limit=30)
    got = sorted((r.doc_id or -1, r.text or "", r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    n = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    assert got == sorted((i or -1, x or "", len((x or "").encode()), n(x), n(x) > 30) for i, x, _ in rows)
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), PATH, 30).count() == 0


def test_ranks_are_the_library():
    rnd = random.Random(8)
    t, fast = bpe.load(PATH), bpe.ranked(PATH)
    pieces = [" " * (k % 2) + "".join(rnd.choices("etaoinshrdlucmfwypvbgkjqxzETAOéüß,.-'12", k=rnd.randint(1, 24))) for k in range(30_000)]
    pieces += ["".join(rnd.choices(["th", "tion", "er", "ing", "an", "st", " re", "ble", "é", "ung", "pre"], k=rnd.randint(1, 6))) for _ in range(30_000)]
    want = [e.ids for e in t.encode_batch(pieces, add_special_tokens=False)]
    assert [fast.encode_ordinary(p) for p in pieces] == want
