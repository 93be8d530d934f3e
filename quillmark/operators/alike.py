"""Comparison of signatures by tokens or characters: cheap bounds first, the exact figures for what passes them."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import text as T

#: A signature's characters as numbers; PAD stands for none.
_CODE = np.full(256, 36, dtype=np.uint8)
_CODE[ord("a") : ord("z") + 1], _CODE[ord("0") : ord("9") + 1] = range(26), range(26, 36)
_PAD, _KINDS = 37, 38
#: Characters of the longest signature that the common subsequence is bounded for, and pairs that are taken at once.
_LONGEST, _AT_ONCE = 512, 2048
#: Texts and pairs of some bundles that are held at once.
_HELD_TEXTS, _HELD_PAIRS = 16_384, 262_144
#: Words that are no tokens of a signature.
_NO_TOKENS = frozenset((*T.STOPWORDS, *"abcdefghijklmnopqrstuvwxyz0123456789", ""))
#: Characters from which difflib leaves out frequent ones.
_POPULAR = 200


def tokens(c: str) -> Column:
    """``text.tokens`` of a signature, whose words are parted by single blanks."""
    return F.filter(F.array_except(F.split(c, " "), F.array(*map(F.lit, T.STOPWORDS))), lambda w: F.length(w) > 1)


def may_share_tokens(x: Column, y: Column, least: float) -> Column:
    """Whether the overlap of two token sets can be ``least``, by their sizes n and 64-bit prints; no pair that has it fails."""
    return F.bit_count(x["print"].bitwiseXOR(y["print"])) <= (x["n"] + y["n"]) * F.lit((1 - least) / (1 + least)) + F.lit(1e-9)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each text as one row of numbers, padded, and the lengths."""
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), int(n.max())), _PAD, dtype=np.uint8)
    out[np.arange(out.shape[1]) < n[:, None]] = _CODE[np.frombuffer("".join(texts).encode(), dtype=np.uint8)]
    return out, n


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of the rows of two tables of ``_codes``, by bits for all rows at once."""
    rows, size = a.shape
    at = np.arange(rows, dtype=np.int64) * _KINDS
    held = [np.zeros(rows * _KINDS, dtype=np.uint64) for _ in range(-(-size // 64))]
    for i in range(size):
        held[i >> 6][at + a[:, i]] |= np.uint64(1 << (i & 63))
    for h in held:
        h[at + _PAD] = 0
    v = [np.full(rows, np.iinfo(np.uint64).max, dtype=np.uint64) for _ in held]
    for j in range(b.shape[1]):
        key, carry = at + b[:, j], None
        for w, h in enumerate(held):
            m = h[key]
            u = v[w] & m
            total = v[w] + u
            over = total < u
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            v[w] = total | (v[w] & ~m)
    return sum(64 - np.bitwise_count(x).astype(np.int64) for x in v)


def _may_be_alike(s: list[str], t: list[str], least: float) -> np.ndarray:
    """Which pairs of texts can have a character ratio of ``least``: matching blocks are a common subsequence, hence no longer than the longest."""
    (a, n), (b, m) = _codes(s), _codes(t)
    rows = np.arange(len(s))[:, None] * _KINDS
    counts = lambda c: np.bincount((rows + c).ravel(), minlength=len(s) * _KINDS).reshape(-1, _KINDS)[:, :_PAD].astype(np.int32)
    need = (n + m) * least / 2 - 1e-6
    able = np.minimum(counts(a), counts(b)).sum(axis=1) >= need
    some = np.flatnonzero(able & (np.minimum(n, m) <= _LONGEST))
    if len(some):
        x, y = a[some], b[some]
        if x.shape[1] > y.shape[1]:
            x, y = y, x
        if x.shape[1] > _LONGEST:  # of some pair the one, of some the other is the long one: each pair by itself
            able[some] = [common_subsequence(p[None, :k], q[None, :l])[0] >= need[i] for i, (p, k, q, l) in ((i, (a[i], n[i], b[i], m[i]) if n[i] <= m[i] else (b[i], m[i], a[i], n[i])) for i in some)]
        else:
            able[some] = common_subsequence(x, y) >= need[some]
    return able


def ratio(s: str, t: str) -> float:
    """The character ratio of two texts as difflib has it: the longest common block, the first of equals, then so on its left and right."""
    if len(t) >= _POPULAR:
        return difflib.SequenceMatcher(None, s, t).ratio()
    find, both, open_ = t.find, 0, [(0, len(s), 0, len(t))]
    while open_:
        begin, end, left, right = open_.pop()
        best, at, to, i = 0, begin, left, begin
        while i + best < end and best < right - left:
            # A block of more than ``best`` characters that begins here, made as long as it is there, then sought further on.
            if (j := find(s[i : i + best + 1], left, right)) >= 0:
                best, at, to = best + 1, i, j
                while i + best < end and j + best < right and s[i + best] == t[j + best]:
                    best += 1
            # Where its second half is nowhere, no such block begins before that half.
            elif best > 3 and find(s[i + (best + 1) // 2 : i + best + 1], left, right) < 0:
                i += (best + 1) // 2 + 1
            else:
                i += 1
        if best:
            both += best
            if begin < at and left < to:
                open_.append((begin, at, left, to))
            if at + best < end and to + best < right:
                open_.append((at + best, end, to + best, right))
    return 2.0 * both / (len(s) + len(t)) if s or t else 1.0


class _Texts:
    """Signatures with their words and tokens, and of each the sizes and counts by which pairs are bounded."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.words = [frozenset(t.split(" ")) for t in texts]
        self.tokens = [x - _NO_TOKENS for x in self.words]
        self.size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.n = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(texts))
        self.print = np.zeros(len(texts), dtype=np.uint64)
        bits = np.fromiter((hash(w) & 63 for x in self.tokens for w in x), dtype=np.uint64, count=int(self.n.sum()))
        some = self.n > 0
        if some.any():
            self.print[some] = np.bitwise_xor.reduceat(np.uint64(1) << bits, (np.cumsum(self.n) - self.n)[some])
        self.short = self.size <= _LONGEST
        self.codes = _codes([t if k else "" for t, k in zip(texts, self.short, strict=True)])[0]
        every = _CODE[np.frombuffer("".join(texts).encode(), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(texts)), self.size) * _KINDS
        self.counts = np.minimum(np.bincount(owner + every, minlength=len(texts) * _KINDS), 255).reshape(-1, _KINDS)[:, :_PAD].astype(np.int16)

    def share_tokens(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        return np.bitwise_count(self.print[a] ^ self.print[b]) <= (self.n[a] + self.n[b]) * ((1 - least) / (1 + least)) + 1e-9

    def share_counts(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Which pairs can have a character ratio of ``least`` by their lengths and the counts of their characters."""
        room = (self.size[a] + self.size[b]) * (1 - least) + 1e-6
        able = np.abs(self.size[a] - self.size[b]) <= room
        some = np.flatnonzero(able)
        able[some] = np.abs(self.counts[a[some]] - self.counts[b[some]]).sum(axis=1) <= room[some]
        return able

    def share_characters(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Which pairs can have it by their longest common subsequence; pairs of like lengths are taken together."""
        able = np.ones(len(a), dtype=bool)
        long = ~(self.short[a] & self.short[b])
        for i in np.flatnonzero(long):
            able[i] = _may_be_alike([self.texts[a[i]]], [self.texts[b[i]]], least)[0]
        longest = np.maximum(self.size[a], self.size[b])
        order = np.argsort(longest, kind="stable")
        order = order[~long[order]]
        for begin in range(0, len(order), _AT_ONCE):
            some = order[begin : begin + _AT_ONCE]
            x, y, width = a[some], b[some], int(longest[some[-1]])
            able[some] = common_subsequence(self.codes[x, :width], self.codes[y, :width]) >= (self.size[x] + self.size[y]) * least / 2 - 1e-6
        return able


def _slabs(l: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bundles of l by r texts with about _HELD_TEXTS texts and _HELD_PAIRS pairs."""
    begin = texts = pairs = 0
    for k, (n, m) in enumerate(zip(l.tolist(), r.tolist(), strict=True), 1):
        texts, pairs = texts + n + m, pairs + n * m
        if texts >= _HELD_TEXTS or pairs >= _HELD_PAIRS or k == len(l):
            yield begin, k
            begin, texts, pairs = k, 0, 0


def compared(least: float, enough: float):
    """The step from bundles (xs ARRAY<STRUCT<id, text, before>>, ys ARRAY<STRUCT<id, text>>) to (sid, tid, overlap, ratio) of the pairs x and y of each that have either of ``least``.

    A pair of which y holds a word of ``before``, by which it has met elsewhere, is left out. The ratio is 0 where it is under ``least`` or the overlap is ``enough``.
    """

    def pairs_of(xs: pa.Array, ys: pa.Array) -> Iterator[tuple[int, int, float, float]]:
        flat, right = xs.flatten(), ys.flatten()
        sid, tid = (c.field("id").to_numpy() for c in (flat, right))
        both = pa.concat_arrays([flat.field("text"), right.field("text")]).dictionary_encode()
        texts, at = _Texts(both.dictionary.to_pylist()), both.indices.to_numpy()
        before = [frozenset(w) for w in flat.field("before").to_pylist()]
        l, r = (pc.list_value_length(c).to_numpy().astype(np.int64) for c in (xs, ys))
        n = l * r
        k = np.repeat(np.arange(len(n)), n)
        q = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        i = (np.cumsum(l) - l)[k] + q // r[k]
        j = (np.cumsum(r) - r)[k] + q % r[k]
        a, b = at[i], at[len(flat) + j]
        by_tokens, by_characters = texts.share_tokens(a, b, least), texts.share_counts(a, b, least)
        some = np.flatnonzero((a != b) & (by_tokens | by_characters))
        words = texts.words
        some = some[np.fromiter((before[x].isdisjoint(words[y]) for x, y in zip(i[some].tolist(), b[some].tolist(), strict=True)), dtype=bool, count=len(some))]
        i, j, a, b, by_tokens, by_characters = (c[some] for c in (i, j, a, b, by_tokens, by_characters))
        by_characters[by_characters] = texts.share_characters(a[by_characters], b[by_characters], least)
        some = np.flatnonzero(by_tokens | by_characters)
        for m, x, y, characters in zip(some.tolist(), a[some].tolist(), b[some].tolist(), by_characters[some].tolist(), strict=True):
            s, t = texts.tokens[x], texts.tokens[y]
            common = len(s & t)
            overlap = common / (len(s) + len(t) - common) if s and t else 0.0
            alike = ratio(texts.texts[x], texts.texts[y]) if characters and overlap < enough - 1e-9 else 0.0
            if max(overlap, alike) >= least - 1e-9:
                yield sid[i[m]], tid[j[m]], overlap, alike

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.schema([("sid", pa.int64()), ("tid", pa.int64()), ("overlap", pa.float64()), ("ratio", pa.float64())])
        for bundle in batches:
            xs, ys = bundle.column("xs"), bundle.column("ys")
            for begin, end in _slabs(*(pc.list_value_length(c).to_numpy() for c in (xs, ys))):
                found = list(pairs_of(xs.slice(begin, end - begin), ys.slice(begin, end - begin)))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 4, names, strict=True)], schema=names)

    return step
