"""Words of a text, in plain Python, for use inside Arrow batches.

The *words* of a text are its maximal runs of letters and digits after HTML
entities are resolved, invisible characters are dropped, compatibility forms
are made plain (NFKC) and letters are lower-cased. A *number* is a word that
holds a digit. ``None`` has no words.
"""

from __future__ import annotations

import html
import re
import unicodedata

import xxhash

# Invisible characters: zero-width ones, soft hyphen, marks of direction, byte order mark.
_INVISIBLE = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")


def plain(text: str) -> str:
    """``text`` with entities resolved, invisible characters dropped, NFKC applied and letters lower-cased."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return text.lower()


def words(text: str | None) -> list[str]:
    """The words of ``text`` in order."""
    if not text:
        return []
    t = plain(text)
    return (_ASCII_WORD if t.isascii() else _WORD).findall(t)


def is_number(word: str) -> bool:
    return _DIGIT.search(word) is not None


def code(word: str) -> int:
    """Signed 64-bit code of a word: the value that Spark's ``xxhash64`` gives for the same string."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


class Codes(dict):
    """Cache of word codes for one task; forgets everything when it holds ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        c = self[word] = code(word)
        return c
