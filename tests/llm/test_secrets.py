import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from urllib.parse import quote

import pytest
from pyspark.sql import types as T

from forumlens.llm import secrets

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("secrets", T.IntegerType())])
b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()


def by_definition(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda f: (f[1], secrets.KINDS.index(f[0])))


def test_base_is_the_definition():
    rnd = random.Random(1)
    atoms = ["password", "TOKEN", "ſecret", "apiKey", "api_key", "toKen", '"', "'", " ", "=", ":", "abc", "AKIA", "ABCD1234", "deadbeef", "0123456789abcdef", "é", "\n", "secret", "passwd", "x" * 6]
    for _ in range(3000):
        t = "".join(rnd.choices(atoms, k=rnd.randint(1, 14)))
        assert secrets.find_secrets(t)[0] == by_definition(t), t


INNER = "password=hunter2xyz"


@pytest.mark.parametrize(
    "wrapped",
    [
        quote(INNER, safe="").replace("p", "%70"),
        "".join(f"\\u{ord(c):04x}" for c in INNER),
        "".join(f"&#{ord(c)};" for c in INNER),
        b64(INNER),
        b64(INNER + "?>").replace("+", "-").replace("/", "_"),
        b64(gzip.compress(INNER.encode())),
        b64(zlib.compress(b64(gzip.compress(quote(INNER, safe="").encode())).encode())),
        quote(b64(b64(b64(INNER))), safe=""),
        "".join(f"\\x{ord(c):02x}" for c in b64(INNER)),
    ],
)
def test_layers(wrapped):
    text = f"é some {wrapped} words"
    base, every, unread = secrets.find_secrets(text)
    assert base == by_definition(text) and set(base) <= set(every) and not unread
    s, e = text.index(wrapped), text.index(wrapped) + len(wrapped)
    hits = [f for f in every if f[0] == "assign" and f not in base]
    assert hits and all(s <= a < b <= e for _, a, b in hits)
    assert any(b - a >= 0.6 * (e - s) for _, a, b in hits)


def test_escapes_map_to_their_places():
    text = "pass%77ord = abc%64ef7 end"
    base, every, _ = secrets.find_secrets(text)
    assert base == [] and every == [("assign", 0, text.index(" end"))]


def test_cycles_and_bombs_end():
    assert secrets.find_secrets("%2525252525") == ([], [], 0)
    bomb = b64(zlib.compress(b"a" * 5_000_000))
    assert secrets.find_secrets(bomb, most=100_000)[2] == 1
    assert secrets.find_secrets(bomb)[2] == 0


def test_rows(spark):
    rows = [(1, INNER, 1), (1, INNER, 1), (None, None, None), (2, "", 2), (3, "x" * 300_000 + " AKIA" + "A" * 16, 0)]
    got = secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()
    finds = sorted((r.doc_id or 0, [tuple(f) for f in r.secrets.every]) for r in got)
    assert finds == [(0, []), (1, [("assign", 0, 19)]), (1, [("assign", 0, 19)]), (2, []), (3, [("access", 300_001, 300_021)])]
    assert secrets.scan_secrets(spark.createDataFrame([], DOCS)).count() == 0


NOISE = " ".join(f"{k * 7919 % 10007}" for k in range(400))
BODY = f"{NOISE} {INNER} {NOISE}"


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    ", "\\n", '" +\n  "'])
@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_wrapped_base64(width, end, pack):
    blob = b64(pack(BODY.encode()))
    wrapped = end.join(blob[k : k + width] for k in range(0, len(blob), width))
    for text in (f"Data:\n{wrapped}\n-----END\n", f"data: {wrapped}\nword", f"key: x{end}{wrapped}"):
        s = text.index(wrapped)
        hits = [f for f in secrets.find_secrets(text)[1] if f[0] == "assign"]
        assert any(s <= a < b <= s + len(wrapped) + 6 and b - a >= 0.8 * len(wrapped) for _, a, b in hits)


@pytest.mark.parametrize(
    "data",
    [
        b"\xe9\xff " + INNER.encode(),
        b"\x00\x01\x02" + INNER.encode() + b"\x00",
        INNER.encode("utf-16"),
        ("\u0436" + INNER).encode("utf-16-be"),
        gzip.compress(b"\x00" * 300 + b"\xe9" + INNER.encode() + b"\x00" * 300),
        gzip.compress(b"first") + gzip.compress(INNER.encode()),
        bz2.compress(b"first") + bz2.compress(INNER.encode()),
        lzma.compress(b"first") + lzma.compress(INNER.encode()),
        gzip.compress(b"first") + INNER.encode(),
    ],
)
def test_all_bytes_of_a_blob(data):
    text = f"some {b64(data)} words"
    assert [f[0] for f in secrets.find_secrets(text)[1]].count("assign") == 1


def test_an_invalid_escape_drops_no_others():
    assert secrets.find_secrets("%ff%70assword%3Dhunter2xyz")[1] == [("assign", 3, 26)]
    assert secrets.find_secrets(r"\ud800\u0070assword=hunter2xyz")[1] == [("assign", 6, 30)]


def test_large_layers_are_read_in_chunks():
    for at in (0, 99_990, 250_000, 399_000):
        data = (b". " * 200_000)[:at] + b" " + INNER.encode() + b" " + b64("x" * 50 + INNER.replace("password", "passwd")).encode() + b" " + (b". " * 200_000)[at:]
        base, every, unread = secrets.find_secrets(b64(gzip.compress(zlib.compress(data))), most=100_000)
        assert not base and [f[0] for f in every] == ["assign"] and not unread


@pytest.mark.parametrize("glue", ["path/", "a/b/", "x-", "some_name_", "p+"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_base64_glued_to_other_text(glue, pack):
    for pad in ("", "a", "ab"):
        text = f"see {glue}{b64(pack((pad + INNER).encode()))} there"
        base, every, _ = secrets.find_secrets(text)
        assert not base and [f[0] for f in every].count("assign") == 1, text


def test_random_nestings_are_found_at_their_place():
    """A secret within random layers is found, and its span covers what stands for it in the text."""
    rnd = random.Random(3)
    url = lambda s: "".join(f"%{b:02X}" if rnd.random() < 0.5 or c == "%" else c for c in s for b in c.encode())
    escaped = lambda s: "".join(f"\\u{ord(c):04x}" if rnd.random() < 0.5 or c in "\\&" else c for c in s)
    entities = lambda s: "".join(f"&#{ord(c)};" if rnd.random() < 0.5 or c in "\\&" else c for c in s)
    packed = lambda s: b64(rnd.choice([gzip.compress, zlib.compress, bz2.compress, lzma.compress])(s.encode()))
    for n in range(300):
        secret = "password=" + "".join(rnd.choices("ghijklmnop", k=rnd.randint(6, 20)))
        s = secret
        chosen = [rnd.choice([url, escaped, entities, b64, packed]) for _ in range(rnd.randint(1, 4))]
        for f in chosen:
            s = f(s)
        before, after = "".join(rnd.choices("é x.\n", k=rnd.randint(0, 20))) + " ", " " + "".join(rnd.choices("ü y.", k=5))
        base, every, unread = secrets.find_secrets(before + s + after)
        hits = [(a, b) for kind, a, b in every if kind == "assign"]
        assert not unread and any(len(before) <= a < b <= len(before) + len(s) and b - a >= 0.5 * len(s) for a, b in hits), (chosen, s)


def test_places_of_a_long_text_are_few():
    text = "x" * 1_000_000 + "%41" + "y" * 1_000_000
    new, places = secrets._unescaped(text, secrets.URL, secrets._url)
    assert len(new) == 2_000_001 and len(places.at) == 3
    assert [places[k] for k in (0, 999_999, 1_000_000, 1_000_001, 2_000_001)] == [0, 999_999, 1_000_000, 1_000_003, 2_000_003]
