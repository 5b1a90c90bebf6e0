"""Secret scans with a recursive decoding worklist.

Each text is a first layer. A layer is scanned, and what is encoded in it becomes further layers: URL escapes,
Unicode escapes, base64, and compressed data inside base64. Layers are unwrapped until none is left; a layer already
seen at the same place is not unwrapped again, which ends cycles. A find in a decoded layer is reported with the span
in the text that it came from: escapes map character by character, blobs map to the whole blob.

Base64 that is wrapped into lines is joined first. Bytes that are no UTF-8 are scanned as Latin-1, and runs of UTF-16 in
them once more, as the patterns are ASCII. What is too large to be held is scanned in overlapping chunks.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forumlens.llm.shared import text_or_empty

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The minimum lengths are in the patterns: a run that is too short holds no start of a longer match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
UNIT = re.compile(r"\\[uUx]\{?([0-9A-Fa-f]+)\}?|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
GLUE = re.compile(r"[/+_-]")
#: How compressed data (gzip, bz2, xz, zstd, zlib) begins in base64, after a mark.
PACKED = re.compile(r"[/+_-](?=H4sI|Qlpo|/Td6WFoA|_Td6WFoA|KLUv[/_]|e[AFJN])")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: What parts the lines of a wrapped blob: a line end, real or written as an escape, with quotes and comment marks.
BETWEEN = r"""["']?[\x20\t]*+(?:[+\\][\x20\t]*+(?=[\r\n]))?(?:\r?\n|\r|\\r\\n|\\n)[\x20\t]*+(?:[>#*|]|//(?=[\x20\t]))?[\x20\t]*+["']?"""
WRAPPED = re.compile(rf"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt]))[A-Za-z0-9+/_-]{{16,}}+(?:{BETWEEN}[A-Za-z0-9+/_-]++)++={{0,2}}")
PARTED = re.compile(BETWEEN)
#: Bytes without any of these hold no find and no further layer.
MAYBE = re.compile(rb"password|passwd|secret|token|api_?key|[A-Z0-9+/_-]{16}|%[0-9a-f]{2}|\\[ux]|&#", re.I)
UTF16 = re.compile(rb"(?:[\x01-\xff]\x00){6,}"), re.compile(rb"(?:\x00[\x01-\xff]){6,}")
#: Bytes of a layer that are scanned at once. A larger one is scanned in chunks of this size. A run of base64 that is
#: itself longer than half a chunk cannot be decoded whole, which is counted in `unread`.
LAYER_BYTES = 256 << 20
#: Bytes that chunks share, bytes that are unfolded at once, and compressions within each other.
OVERLAP, PIECE, DEEP = 1 << 16, 1 << 20, 1000
RUN_BYTES = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=\r\n"


def scan_layer(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and non-overlapping for each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


class Places:
    """Where the characters of a layer stand in the text, in runs: from at[k] on, they are from to[k] on one by one."""

    def __init__(self):
        self.at, self.to = array("q"), array("q")

    def add(self, at: int, to: int) -> None:
        self.at.append(at)
        self.to.append(to)

    def __getitem__(self, k: int) -> int:
        run = bisect_right(self.at, k) - 1
        return self.to[run] + k - self.at[run]

    def within(self, outer: Places) -> Places:
        """These places, which are in a layer, as places in the text that the layer's are in."""
        out = Places()
        for k, (at, to) in enumerate(zip(self.at, self.to, strict=True)):
            out.add(at, outer[to])
            if k + 1 < len(self.at):
                end = to + self.at[k + 1] - at
                for r in range(bisect_right(outer.at, to), bisect_left(outer.at, end)):
                    out.add(at + outer.at[r] - to, outer.to[r])
        return out

    def key(self) -> bytes:
        return hashlib.sha256(self.at.tobytes() + b"/" + self.to.tobytes()).digest()


def _unescaped(text: str, pattern: re.Pattern, decode) -> tuple[str, Places] | None:
    """The text with escapes decoded, and the places of its characters (and of its end) in `text`."""
    parts, places, at, size = [], Places(), 0, 0
    for m in pattern.finditer(text):
        if m.start() > at:
            places.add(size, at)
            parts.append(text[at : m.start()])
            size += m.start() - at
        chars, starts = decode(m)
        for k, start in enumerate(starts):
            places.add(size + k, start)
        parts.append(chars)
        size += len(chars)
        at = m.end()
    if not at:
        return None
    parts.append(text[at:])
    places.add(size, at)
    return "".join(parts), places


def _url(m: re.Match) -> tuple[str, list[int]]:
    chars, starts, at = [], [], m.start()
    for c in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
        starts.append(at)
        alone = 0xDC80 <= ord(c) < 0xDD00  # a byte that is no UTF-8
        chars.append(chr(ord(c) & 0xFF) if alone else c)
        at += 3 if alone else 3 * len(c.encode("utf-8"))
    return "".join(chars), starts


def _unicode(m: re.Match) -> tuple[str, list[int]]:
    chars, starts = [], []
    for u in UNIT.finditer(m.group()):
        code = int(u[1] or u[3], 16) if u[1] or u[3] else int(u[2])
        if code > 0x10FFFF:
            code = 0xFFFD
        if 0xDC00 <= code < 0xE000 and chars and 0xD800 <= ord(chars[-1]) < 0xDC00:
            chars[-1] = chr(0x10000 + ((ord(chars[-1]) - 0xD800) << 10) + code - 0xDC00)
        else:
            chars.append(chr(code))
            starts.append(m.start() + u.start())
    return "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in chars), starts


def _packed(data: bytes) -> str | None:
    if data[:2] == b"\x1f\x8b" or (len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0):
        return "zlib"
    starts = {b"BZh": "bz2", b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
    return next((kind for start, kind in starts.items() if data.startswith(start)), None)


def _unfold(chunks: Iterator[bytes], failed: list) -> Iterator[bytes]:
    """What a compressed stream unfolds to, member after member, and the bytes after the last as they are."""
    data = b""
    while True:
        while len(data) < 6 and (more := next(chunks, None)) is not None:
            data += more
        kind = _packed(data)
        if kind is None:
            yield data
            yield from chunks
            return
        try:
            if kind == "zstd":
                import zstandard

                d = zstandard.ZstdDecompressor().decompressobj()
            else:
                d = zlib.decompressobj(47) if kind == "zlib" else bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor()
            while not d.eof:
                if kind == "zstd":  # has no limit to its output
                    out, data = d.decompress(data[:256]), data[256:]
                    wanting = not data
                elif kind == "zlib":
                    out = d.decompress(data, PIECE)
                    data = d.unconsumed_tail
                    wanting = not data and len(out) < PIECE
                else:
                    out, data = d.decompress(data, PIECE), b""
                    wanting = d.needs_input
                if out:
                    yield out
                if wanting and not d.eof:
                    data = next(chunks, None)
                    if data is None:
                        return
            data = d.unused_data + (data if kind == "zstd" else b"")
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, RuntimeError):
            failed.append(kind)
            return
        except Exception as e:  # zstandard's own error type
            if type(e).__module__.startswith("zstandard"):
                failed.append(kind)
                return
            raise


def _chunks(stream: Iterator[bytes], most: int, lost: list) -> Iterator[bytes]:
    """Overlapping parts of a stream, cut where no base64 runs on."""
    held, cut_run = bytearray(), False
    for piece in stream:
        held += piece
        if len(held) < most:
            continue
        tail = bytes(held[-(most // 2) :])
        runs = len(tail) - len(tail.rstrip(RUN_BYTES))
        cut_run |= runs == len(tail)
        yield bytes(held)
        del held[: max(1, len(held) - runs - min(OVERLAP, most // 4))]
    if held:
        yield bytes(held)
    if cut_run:
        lost.append("run")


def _unfolded(data: bytes, most: int, lost: list) -> Iterator[bytes]:
    """What data unfolds to, through all compressions: whole, or in chunks if it is larger than `most`."""
    seen = set()
    while _packed(data) and len(seen) < DEEP:
        seen.add(hashlib.sha256(data).digest())
        failed: list = []
        parts = _unfold((data[k : k + OVERLAP] for k in range(0, len(data), OVERLAP)), failed)
        out = bytearray()
        for piece in parts:
            out += piece
            if len(out) > most:
                break
        if len(out) > most:
            stream, head, deep = chain([bytes(out)], parts), bytes(out[:6]), 0
            while _packed(head) and deep < DEEP:
                stream, deep = _unfold(stream, failed), deep + 1
                head = next(stream, b"")
                stream = chain([head], stream)
            yield from _chunks(stream, most, lost)
            if failed or deep == DEEP:
                lost.append("rest")
            return
        if failed:  # no compressed data, or damaged
            if out:
                yield bytes(out)
            break
        if hashlib.sha256(out).digest() in seen:
            break
        data = bytes(out)
    yield data


def _texts(data: bytes) -> Iterator[str]:
    if MAYBE.search(data):
        try:
            yield data.decode("utf-8")
        except UnicodeDecodeError:
            yield data.decode("latin-1")
    if b"\x00" in data:
        for pattern in UTF16:
            if runs := [r.replace(b"\x00", b"") for r in pattern.findall(data)]:
                yield b"\x00".join(runs).decode("latin-1")


def _blob(token: str, most: int, lost: list) -> Iterator[str]:
    """The texts that a run of base64 decodes to.

    Letters of other text can be glued to its front by a mark that base64 has too, as in a path. Text is then found in
    one of the four ways to start, and compressed data from the mark on.
    """
    body = token.rstrip("=")
    starts = [(0, False)]
    if GLUE.search(body):
        starts += [(1, False), (2, False), (3, False), *((m.end(), True) for m in PACKED.finditer(body))]
    for start, packed in starts:
        part = body[start : len(body) - ((len(body) - start) % 4 == 1)]
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4), b"-_" if "-" in part or "_" in part else None)
        except (binascii.Error, ValueError):
            continue
        if packed and not _packed(data):
            continue
        for out in _unfolded(data, most, lost) if packed or not start else (data,):
            yield from _texts(out)


def _wrapped(layer: str) -> Iterator[tuple[str, int, int]]:
    """(joined lines, start, end) of base64 in lines of equal length, but for the first and the last.

    The first line can begin within a line of other text, and a line after the last can be a word of other text, so
    that both are tried with and without.
    """
    for m in WRAPPED.finditer(layer):
        lines, at = [], m.start()
        while line := LINE.match(layer, at, m.end()):
            lines.append(line.span())
            gap = PARTED.match(layer, line.end(), m.end())
            if gap is None:
                break
            at = gap.end()
        size = [e - s for s, e in lines]
        k = 0
        while k < len(lines) - 1:
            # From line k: one line of any length, lines as long as the next one, a last one that is not longer.
            last = k + 1
            while last < len(lines) - 1 and size[last] == size[k + 1] and size[last + 1] <= size[k + 1]:
                last += 1
            firsts = {k} | ({k + 1} if size[k] != size[k + 1] else set())
            for first in firsts:
                for end in {last, last - 1}:
                    if end > first:
                        yield "".join(layer[s:e] for s, e in lines[first : end + 1]), lines[first][0], lines[end][1]
            k = last


def find_secrets(text: str, most: int = LAYER_BYTES) -> tuple[list, list, int]:
    """(finds of the text itself, all finds, layers that were not read whole), as (kind, start, end) in order."""
    order = lambda f: (f[1], KINDS.index(f[0]), f[2])
    base = sorted(scan_layer(text), key=order)
    every, unread, seen = set(base), 0, set()

    def span(places, s: int, e: int) -> tuple[int, int]:
        if places is None:
            return s, e
        return places if isinstance(places, tuple) else (places[s], places[e])

    def inner(layer: str, places) -> Iterator:
        nonlocal unread
        for mark, pattern, decode in (("%", URL, _url), ("\\", UNICODE, _unicode), ("&#", UNICODE, _unicode)):
            if mark in layer and (got := _unescaped(layer, pattern, decode)):
                new, at = got
                yield new, places if isinstance(places, tuple) else at if places is None else at.within(places)
        blobs = ((m.group(), m.start(), m.end()) for m in BASE64.finditer(layer))
        for token, s, e in chain(blobs, _wrapped(layer)):
            lost: list = []
            for new in _blob(token, most, lost):
                yield new, span(places, s, e)
            unread += bool(lost)

    # Layers are made when they are wanted, so that of a large one only a chunk is held.
    todo = [iter([(text, None)])]
    while todo:
        # places: None for the text itself, a list of places in the text, or the span of a blob.
        layer, places = next(todo[-1], (None, None))
        if layer is None:
            todo.pop()
            continue
        if places is not None:
            here = (hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest(), places if isinstance(places, tuple) else places.key())
            if here in seen:
                continue
            seen.add(here)
            every.update((kind, *span(places, s, e)) for kind, s, e in scan_layer(layer))
        todo.append(inner(layer, places))
    return base, sorted(every, key=order), unread


FOUND = "struct<base:array<struct<kind:string,start:long,end:long>>,every:array<struct<kind:string,start:long,end:long>>,unread:long>"


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of `docs` plus `secrets`: base finds, all finds, and the number of unread layers.

    Null and empty texts have no finds. Very long texts are scanned whole; what is decoded from them is held in parts of
    LAYER_BYTES, and `unread` counts the layers of which a part could not be decoded. Finds are ordered by start, then
    kind, then end, so that ties are in a fixed order. Repeated rows come out as often as they come in, each with its
    finds. Places count code points, ends are exclusive. An input column named secrets is replaced, whatever its case;
    an empty table gives an empty result.
    """
    as_rows = lambda fs: [{"kind": k, "start": s, "end": e} for k, s, e in fs]

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.DataFrame:
        got = [find_secrets(t) for t in texts]
        return pd.DataFrame({"base": [as_rows(b) for b, _, _ in got], "every": [as_rows(e) for _, e, _ in got], "unread": [u for _, _, u in got]})

    return docs.drop("secrets").withColumn("secrets", scan(text_or_empty(text_col)))
