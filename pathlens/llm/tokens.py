"""Exact, cached encoding with public tokenizer files.

Both pre-tokenizers cut a text at white space and between a Latin letter run and a following ASCII sign other than
an apostrophe, whatever stands around, so a text's ids are the ids of such pieces in a row. Each worker keeps a
bounded dictionary of pieces; unseen single words go to the BPE model itself, after the ids of the line breaks
before them, and other pieces and texts with unusual white space through the whole tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: White space other than space, tab, newline and return: such texts are encoded whole.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
END_IDS = {"byte_bpe_50k.json": 2, "word_bpe_49k.json": 0}
CACHE_ENTRIES = 500_000
SIGNS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def byte_chars() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stays, other bytes move up from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """piece -> its ids' bytes. A full dictionary stays as it is, as frequent pieces come first."""

    def __init__(self, whole, lower: bool, room: int):
        super().__init__()
        self.whole, self.tokenize, self.lower, self.room = whole, whole.model.tokenize, lower, room
        self.single = re.compile(rf"([ \t\n\r]*?)({'' if lower else ' ?'}[{LETTERS}]+)").fullmatch
        self.before: dict[tuple[str, bool], bytes] = {}  # ids of white space before a word
        chars = byte_chars()
        self.spell = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(256)}

    def __missing__(self, piece: str) -> bytes:
        if m := self.single(piece):
            gap, word = m.groups()
            raw = array("I", [t.id for t in self.tokenize((word.lower() if self.lower else word).translate(self.spell))]).tobytes()
            if gap:
                raw = self.gap(gap, word[0] == " ") + raw
        else:
            raw = array("I", self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self) < self.room:
            self[piece] = raw
        return raw


    def gap(self, gap: str, space: bool) -> bytes:
        """The ids of white space before a word, with a space of its own or without."""
        if (gap, space) not in self.before:
            word = " a" if space else "a"
            own, both = (self.whole.encode(t, add_special_tokens=False).ids for t in (word, gap + word))
            assert both[len(both) - len(own) :] == own
            if len(self.before) > 1000:
                self.before.clear()
            self.before[gap, space] = array("I", both[: len(both) - len(own)]).tobytes()
        return self.before[gap, space]


class Encoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        lower = '"Lowercase"' in self.whole.to_str()[:4000]
        space, tail = ("", "") if lower else (r"[ \t\n\r]*", r"|[ \t\n\r]+")
        self.cut = re.compile(rf"{space}[{LETTERS}]++(?![^ \t\n\r{SIGNS}])|{space}[^ \t\n\r]+{tail}").findall
        self.pieces = Pieces(self.whole, lower, cache_entries)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if ODD_SPACE.search(text):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4")
