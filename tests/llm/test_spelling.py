import random
import re
import zlib
from collections import Counter

import pytest

from forumlens.llm import spelling


def near(a, b):
    """By all deletions, which is another way than the operator's."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, damage=spelling.DAMAGE, min_length=6, min_count=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= min_length and k >= min_count}
    form, out = {}, {}
    for w in n:
        others = [o for o in n if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
        out[w] = (n[w], len(others))
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w], n[form[w]] if form[w] else None)
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abéß") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for _ in range(40):
            w = rnd.choice(stems[: rnd.randint(1, 60)])
            if rnd.random() < 0.3:
                at = rnd.randrange(len(w))
                w = rnd.choice([w[:at] + w[at + 1 :], w[:at] + "a" + w[at:], w[:at] + "b" + w[at + 1 :]])
            words.append(w.upper() if w.isascii() and rnd.random() < 0.2 else w)
        rows.append((i, rnd.choice([" ", "-", "7", "×", "\n"]).join(words)))
    rows += [(1000 + k, "chainword " + "chainxord " * (k % 8 == 0) + "chainxxrd " * (k % 64 == 0)) for k in range(400)]
    return rows + [(None, ""), (7, None), (8, ""), (7, rows[7][1]), (9, "abcdefg " * 5000 + "abcdefh " * 6), (10, "a" * 50_000)]


@pytest.mark.parametrize("cell", [spelling.CELL, 40])
@pytest.mark.parametrize("damage", [spelling.DAMAGE, 3])
def test_against_brute_force(spark, cell, damage):
    """Also with cells so small that nearly all are halved down to one letter."""
    rows = [(i, t, "n", "word") for i, t in corpus()]
    df = spark.createDataFrame(rows, "doc_id int, text string, n string, word string")
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(df, damage=damage, cell=cell).collect()}
    want = brute([r[:2] for r in rows], damage)
    assert len(want) > 200 and any(v[0] for v in want.values()) and any(v[0] != v[1] for v in want.values() if v[0])
    assert got == want


def test_one_edit_is_exact():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(300)]
    assert all(spelling.one_edit(a, b) == near(a, b) for a in words for b in words)


def test_a_cell_merges_postings_under_all_windows():
    """Every window of every pair of near words that share what is around it finds the pair, from q-grams of any length."""
    rnd = random.Random(2)
    for _ in range(400):
        word = "".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9)))
        at = rnd.randrange(len(word))
        other = rnd.choice([word[:at] + "c" + word[at + 1 :], word[:at] + rnd.choice("ab") + word[at:]])
        shortest = len(word)
        for low in range(at + 1):
            for high in range(max(low + 1, at + (len(other) == len(word))), len(word) + 1):
                tail = len(word) - high
                if word[:low] == other[:low] and word[high:] == other[len(other) - tail :]:
                    for q in (2, 3):
                        assert list(spelling.near_in_cell([word, other], shortest, low, high, q)) == [(0, 1)]


def test_hot_half(spark):
    """Thousands of words with one first half: cells are halved and nothing is lost."""
    rnd = random.Random(5)
    words = sorted({"commonhead" + "".join(rnd.choice("abcdef") for _ in range(6)) for _ in range(3000)})
    pairs = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string"), cell=2000).collect()
    want = {(a, b) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)}
    assert {tuple(sorted(p)) for p in pairs} == want and len(pairs) == len(want) > 1000


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert spelling.spelling_variants(df).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.spelling_variants(df).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, "short words"), (2, None)], df.schema)).count() == 0
