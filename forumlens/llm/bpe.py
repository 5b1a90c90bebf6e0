"""Byte-level BPE of whole texts through worker caches, with the ids that the tokenizers library gives.

Byte-level BPE never merges across pre-tokens, so that a text's ids are those of its pre-tokens in order. Texts of printable
ASCII, white space and Latin letters are split by the public pattern; there its classes are beyond doubt in every version of
Unicode. Texts with other characters are split by the library's own pre-tokenizer, and looked up likewise. Only texts with
the string of an added token, which the library treats apart, go to it as a whole.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Characters of other texts than plain ones, and the public pattern for plain ones.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ſ]")
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-ſ]+| ?[0-9]+| ?[^\sA-Za-z0-9\xc0-ſ]+|\s+(?!\S)|\s+")
#: Entries of a worker's cache; when it is full it starts anew.
CACHE = 150_000
#: Characters of a piece that is kept, at most.
KEPT = 48


def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


#: Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def ranked(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as an encoding by ranks, which takes a fifth of the library's time for short pieces.

    None if ids don't follow the order of the merges, for then ranks would say something else.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges, to_byte = model["vocab"], model["merges"], byte_of()
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    if made != sorted(made) or len(set(made)) != len(made) or made[:1] == [-1] or model.get("dropout") or any(c not in to_byte for t in vocab for c in t):
        return None
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("pieces", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(vocab) else None


class PieceCache(dict):
    """piece -> what `value` makes of its ids; a miss is encoded and kept."""

    def __init__(self, encode, value, known: dict | None = None):
        super().__init__(known or {})
        self.encode, self.value, self.known = encode, value, known or {}

    def __missing__(self, piece: str):
        out = self.value(self.encode(piece))
        if len(piece) <= KEPT:
            if len(self) - len(self.known) >= CACHE:
                self.clear()
                self.update(self.known)
            self[piece] = out
        return out


def ids_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Encoder:
    """Encodes texts with a PieceCache. `value` is len, or ids_bytes for ids as little-endian 32-bit integers."""

    def __init__(self, path: str, value, known: dict | None = None):
        self.path, self.value = path, value
        self.fast = ranked(path)
        self.pieces = PieceCache(self.piece, value, known)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        pre = config.get("pre_tokenizer") or {}
        #: Whether pieces are what the pattern makes, and are looked at by themselves.
        self.apart = not config.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)

    @cached_property
    def tokenizer(self) -> Tokenizer:
        """The library's tokenizer, loaded for the first text that needs it: it takes more memory than all else."""
        return load(self.path)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def piece(self, piece: str) -> list[int]:
        return self.whole(piece) if self.fast is None or OTHER.search(piece) else self.fast.encode_ordinary(piece)

    def split(self, text: str) -> list[str] | None:
        """The pre-tokens of the text; None if it goes to the library as a whole."""
        if not self.apart or any(a in text for a in self.added):
            return None
        if not OTHER.search(text):
            return PLAIN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        pieces = self.split(text)
        return len(self.whole(text)) if pieces is None else sum(map(self.pieces.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        pieces = self.split(text)
        return ids_bytes(self.whole(text)) if pieces is None else b"".join(map(self.pieces.__getitem__, pieces))


@lru_cache(maxsize=4)
def worker_encoder(path: str, kind: str) -> Encoder:
    """One encoder a Python worker, kept between tasks. kind: 'len' or 'ids'."""
    return Encoder(path, len if kind == "len" else ids_bytes)
