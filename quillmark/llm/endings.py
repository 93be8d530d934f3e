"""A backward character n-gram model of how texts end.

For a place in a text, its context is the run of characters that ends there. The model counts, over all texts, how often
a context is followed by an end (a closing mark, a new line or the end of the text) and how often the text goes on. The
log-odds of the two for the final context of a value say whether its author can have stopped there.

Contexts have several lengths, read backwards from the end; the longest that was seen often enough decides. Besides the
plain contexts there are masked ones, which hold what stands before the last word, whatever that is (for names and numbers
that no other text holds). Plain contexts that lie within the last word can't say whether a sentence may end after it, but
they say whether the word itself may; the lower log-odds count. The kind of the last line (prose, list, table, code and so on) is part of every context, so that an
end that is usual in a list isn't taken for one in prose.

Only the contexts that some value ends in are counted. A bitmap with some sixteen bits for each of them (up to MOST_BITS) is
broadcast and spares the rest before anything is shuffled. A context is looked for only where its shorter ones are wanted, since all
lengths of an end are. All occurrences are counted: a task holds counts of about MOST_CONTEXTS contexts, and where there are more it
hands on what it has and begins anew; the shuffle adds up the parts of a context. The end of a text and of its exact copies isn't
held for or against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.filters import bitmap, marked

#: Lengths of the plain contexts, longest first.
ORDERS = (24, 18, 13, 9, 6, 4)
#: Lengths of what stands before a masked word.
MASKED = (20, 12, 6)
#: Characters before the last word from which a plain context says more than the word itself.
_BEYOND = 4
#: Occurrences, besides its own, that a context must have to decide.
SUPPORT = 3
#: Least and most bits of the bitmap of wanted contexts; the most are 32 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Contexts that a task holds counts of before it hands them on.
MOST_CONTEXTS = 1 << 20

#: Characters of the end in which a trace is looked for, and of what is counted at once; longer texts are taken in pieces that
#: overlap by more than the longest context.
_TRACE, _PIECE, _OVER = 80, 400_000, 400

CLOSING = ".!?。！？…؟।"
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))
_SPACE = re.compile(r"[^\S\n]{2,}|[^\S\n ]")
_NEWLINES = re.compile(r" ?\n[ \n]*")
_LIST = re.compile(r"\s*(?:[-*+•·]|\d+[.)])\s")
_FENCE = re.compile(r"^[^\S\n]*(?:```|~~~)", re.M)
_BLOCK = re.compile(r"^[^\S\n]*(?:```|~~~).*?^[^\S\n]*(?:```|~~~)[^\n]*$", re.M | re.S)
_SPAN = re.compile(r"(`+)[^`]+\1")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_OPENS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "“": "”", "„": "“”"}
_DELIMITER = re.compile("`+|[\"" + re.escape("".join({c for k, v in _OPENS.items() for c in k + v})) + "]")
_LEADING = "([{（“„'‘—–-/*_"

# What a cut may leave at the end of a value. Hard traces are broken bytes, escapes, entities and tags.
_HARD = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\|&(?:#x?[0-9a-fA-F]{0,6}|am?p?|lt?|gt?|qu?o?t?|nb?s?p?|ap?o?s?)?|</?(?:[a-zA-Z][^<>\n]{0,40})?)$")
_SOFT = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…|cut|truncated|continued|more|snip)\s*\]|\(\s*(?:\.\.\.|…|cut|truncated|continued|more)\s*\)|\.{2,}|…+|>{2,}|(?<=\s)-{1,2}|—)\s*$", re.I)


def shape(text: str) -> str:
    """``text`` as the model reads it: runs of blanks made one, and none at the ends of lines; ``Positions`` makes digits alike."""
    t = _SPACE.sub(" ", text) if "  " in text or not text.isascii() or not text.isprintable() else text
    return (_NEWLINES.sub("\n", t) if "\n" in t else t).strip()


def line_kind(line: str) -> int:
    if _LIST.match(line):
        return 1
    c = line.lstrip()[:1]
    if c == "|":
        return 2
    if c in "{[":
        return 3
    if c in "—–>#":
        return 4
    return 0


def strip_trace(text: str) -> tuple[str, str | None]:
    """The text without what a cut left at its end, and 'hard', 'soft' or None for what that was."""
    t = text.rstrip()
    tail = t[-_TRACE:]
    for pattern, name in ((_HARD, "hard"), (_SOFT, "soft")):
        m = pattern.search(tail)
        if m and m.group():
            return t[: len(t) - len(tail) + m.start()].rstrip(), name
    return t, None


def open_fence(text: str) -> bool:
    """Whether a code block is begun and not closed."""
    return len(_FENCE.findall(text)) % 2 == 1


def open_delimiter(text: str) -> bool:
    """Whether the last paragraph of prose begins a bracket, a quotation or a code span and doesn't close it.

    Earlier paragraphs aren't looked at: a quotation of many paragraphs begins each with a mark and closes the last alone.
    """
    prose = _BLOCK.sub("\n", text) if _FENCE.search(text) else text
    paragraph = _PARAGRAPH.split(prose.rstrip())[-1] if len(prose) < _PIECE else _PARAGRAPH.split(prose[-_PIECE:].rstrip())[-1]
    stack: list[str] = []
    for m in _DELIMITER.finditer(_SPAN.sub(" ", paragraph)):
        c, before, after = m.group()[0], m.string[m.start() - 1 : m.start()], m.string[m.end() : m.end() + 1]
        leads = (not before or before.isspace() or before in _LEADING) and bool(after) and not after.isspace()
        if c in "\"`":
            if c in stack:
                del stack[stack.index(c) :]
            elif leads:
                stack.append(c)
        elif c == "“" and "„" in stack:
            del stack[stack.index("„") :]
        elif c in _OPENS:
            if not (c == "(" and before and before in ":;=-'"):  # a face
                stack.append(c)
        else:
            like = [i for i, o in enumerate(stack) if c in _OPENS.get(o, "")]
            if like:
                del stack[like[-1] :]
            elif stack and stack[-1] in "([" and c in ")]":  # a half-open interval
                stack.pop()
    return bool(stack)


class Positions:
    """The places of some shaped texts: what follows each, and the keys of the contexts that end there."""

    PAD = max(ORDERS)
    _powers = np.ones(1, dtype=np.uint64)
    _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, texts: list[str], goes_on: list[bool] | None = None, skip: list[int] | None = None, kinds: list[int] | None = None):
        """``goes_on`` marks pieces of a longer text, of whose last position nothing is known; of each text the first ``skip``
        characters are context alone, and ``kinds`` gives the kind of its first line."""
        pad = "\x02" * self.PAD
        joined = "".join(f"{pad}{t}\x03" for t in texts) + pad
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        c[(c >= 48) & (c <= 57)] = 48
        begins = np.cumsum([0, *(len(pad) + len(t) + 1 for t in texts)])[:-1] + len(pad)
        self.last = begins + np.array([len(t) for t in texts], dtype=np.int64) - 1
        of_line = np.zeros(len(c), dtype=np.uint64)
        for n, (t, begin) in enumerate(zip(texts, begins.tolist(), strict=True)):
            at = begin
            for i, line in enumerate(t.split("\n")):
                k = kinds[n] if kinds and i == 0 else line_kind(line) if line else 0
                if k:
                    of_line[at : at + len(line)] = k
                at += len(line) + 1
        follow, after = np.full_like(c, 2), np.full_like(c, 2)
        follow[:-1], after[:-2] = c[1:], c[2:]
        closing = np.isin(follow, np.array([ord(x) for x in CLOSING], dtype=np.uint32)) & ~((follow == 46) & (after == 48))
        letter = self._letters(c)
        self.inside = self._letters(follow)
        self.end = closing | (follow == 3) | (follow == 10)
        self.real = (c > 3) & (c != 10) & (c != 32)
        if goes_on is not None:
            self.real[self.last[np.array(goes_on, dtype=bool)]] = False
        for begin, n in zip(begins.tolist(), skip or (), strict=False):
            self.real[begin : begin + n] = False
        self.kinds = of_line
        #: The last place up to each that holds no letter.
        self.start = np.maximum.accumulate(np.where(letter, 0, np.arange(len(c))))
        cls = Positions
        if len(cls._powers) < len(c):
            cls._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), _B, dtype=np.uint64)]), dtype=np.uint64)
            cls._inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(c), _B_INVERSE, dtype=np.uint64)]), dtype=np.uint64)
        self._sums = np.zeros(len(c) + 1, dtype=np.uint64)
        np.cumsum(c.astype(np.uint64) * cls._powers[: len(c)], out=self._sums[1:])

    @staticmethod
    def _letters(c: np.ndarray) -> np.ndarray:
        return ((c >= 97) & (c <= 122)) | ((c >= 65) & (c <= 90)) | (c == 48) | (c == 45) | ((c >= 0xC0) & (c < 0x250))

    def _keys(self, ends: np.ndarray, at: np.ndarray, k: int, order: int) -> np.ndarray:
        """Keys of the k characters up to ``ends``, on the lines of the places ``at``."""
        h = (self._sums[ends + 1] - self._sums[ends + 1 - k]) * Positions._inverse[ends]
        h = (h + np.uint64(order)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ self.kinds[at] * np.uint64(0xA24BAED4963EE407)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def plain(self, at: np.ndarray, k: int) -> np.ndarray:
        return self._keys(at, at, k, k)

    def masked(self, at: np.ndarray, k: int) -> np.ndarray:
        return self._keys(self.start[at], at, k, 100 + k)

    def sought(self, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys, places) of the contexts that the bitmap may hold, length by length, the shorter ones first."""
        for at, orders, make in ((np.flatnonzero(self.real), ORDERS, self.plain), (np.flatnonzero(self.real & ~self.inside), MASKED, self.masked)):
            for k in sorted(orders):
                keys = make(at, k)
                hit = marked(table, keys)
                keys, at = keys[hit], at[hit]
                if not len(at):
                    break
                yield keys, at


def final_keys(cores: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The keys of the final context of each text, in the order in which they may decide, and those within its last word."""
    if not cores:
        return []
    reach = 20 * Positions.PAD
    # The last line, for its kind, and enough before the end for the longest context.
    starts = [t.rfind("\n") + 1 for t in cores]
    p = Positions([shape(t[max(0, min(at - reach, len(t) - reach)) :] if len(t) - at < 4 * reach else t[-reach:]) for t, at in zip(cores, starts, strict=True)])
    p.kinds[p.last] = [line_kind(t[at : at + reach]) for t, at in zip(cores, starts, strict=True)]
    keys = np.stack([*(p.plain(p.last, k) for k in ORDERS), *(p.masked(p.last, k) for k in MASKED)], axis=1).view(np.int64)
    # In the order in which they may decide; then those within the last word, for the word alone.
    plain = np.array(ORDERS)
    masked = np.arange(len(ORDERS), len(ORDERS) + len(MASKED))
    out = []
    for k, n in zip(keys, p.last - p.start[p.last], strict=True):
        before = np.concatenate([np.flatnonzero(plain > n + _BEYOND), masked, np.flatnonzero((plain <= n + _BEYOND) & (plain > n))])
        out.append((k[before], k[: len(ORDERS)][plain <= n]))
    return out


def _chunks(texts: list[str]) -> Iterator[Positions]:
    """The places of the texts, about _PIECE characters at a time; a longer text comes in pieces that overlap."""
    held: list[tuple[str, bool, int, int]] = []
    n = 0
    for text in texts:
        t = shape(text)
        for at in range(0, max(1, len(t)), _PIECE):
            begin = max(0, at - _OVER)
            line = t.rfind("\n", 0, begin) + 1
            held.append((t[begin : at + _PIECE], at + _PIECE < len(t), at - begin, line_kind(t[line : line + _OVER]) if begin else line_kind(t[: t.find("\n") if "\n" in t else len(t)][:_OVER])))
            n += len(held[-1][0])
            if n >= _PIECE:
                yield Positions(*map(list, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield Positions(*map(list, zip(*held, strict=True)))


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, and of each the sums of its counts."""
    at, distinct = pd.factorize(keys)
    return distinct, *(np.bincount(at, weights=c, minlength=len(distinct)).astype(np.int64) for c in counts)


class _Tally:
    """Counts (key, ends, inside, total) of a task, handed on in parts where there are too many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, p: Positions, table: np.ndarray) -> None:
        got = list(p.sought(table))
        if not got:
            return
        at = np.concatenate([places for _, places in got])
        self.parts.append(_summed(np.concatenate([k for k, _ in got]), p.end[at], p.inside[at], np.ones(len(at))))
        self.held += len(self.parts[-1][0])

    def full(self) -> bool:
        """Whether more than MOST_CONTEXTS are held once those met several times are one."""
        if self.held > 2 * MOST_CONTEXTS:
            self.parts = [_summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))]
            self.held = len(self.parts[0][0])
            return self.held > MOST_CONTEXTS
        return False

    def handed_on(self) -> Iterator[pd.DataFrame]:
        """All that is held, in pieces; nothing is held then."""
        if not self.parts:
            return
        keys, ends, inside, total = _summed(*(np.concatenate(c) for c in zip(*self.parts, strict=True)))
        self.parts, self.held = [], 0
        for at in range(0, len(keys), 100_000):
            s = slice(at, at + 100_000)
            yield pd.DataFrame({"key": keys[s].view(np.int64), "ends": ends[s], "inside": inside[s], "total": total[s]})


def _counts(held):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, tally = held.value, _Tally()
        for b in batches:
            for p in _chunks([strip_trace(t)[0] for t in b["text"]]):
                tally.add(p, table)
                if tally.full():
                    yield from tally.handed_on()
        yield from tally.handed_on()

    return step


def log_odds(texts: DataFrame, ends: DataFrame, least_bits: int | None = None) -> DataFrame:
    """(class, log_odds) of an end at the final contexts in ends(class BINARY, keys, within ARRAY<BIGINT>; see ``final_keys``).

    The contexts are counted in all of texts(text STRING), without the traces of cuts. ``class`` is a digest that copies of
    a text share. log_odds is null where no context was seen often enough, not even the shortest.
    """
    spark = texts.sparkSession
    finals = ends.groupBy("class", "keys", "within").agg(F.count("*").alias("copies")).persist(StorageLevel.MEMORY_AND_DISK)
    wanted = finals.select(F.explode(F.concat("keys", "within")).alias("key"))
    bits = least_bits or LEAST_BITS
    need = 16 * wanted.count()
    while bits < min(need, MOST_BITS):
        bits *= 4
    held = spark.sparkContext.broadcast(bitmap(wanted, bits))
    counts = texts.where("text is not null").select("text").mapInPandas(_counts(held), "key long, ends long, inside long, total long").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("ends", "inside", "total")))
    one = lambda c, within: F.transform(c, lambda x, i: F.struct(x.alias("key"), i.alias("rank"), F.lit(within).alias("within")))
    asked = finals.select("class", "copies", F.explode(F.concat(one("keys", False), one("within", True))).alias("a")).select("class", "copies", "a.*")
    # A text's own end and those of its copies are neither for nor against it.
    ends, total = F.greatest(F.col("ends") - F.col("copies"), F.lit(0)), F.col("total") - F.col("copies")
    seen = asked.join(counts, "key").where(total >= SUPPORT)
    odds = F.log((ends + F.lit(0.25)) / (total - ends + F.lit(0.25)))
    word = F.log((total - F.col("inside") + F.lit(0.25)) / (F.col("inside") + F.lit(0.25)))
    first = lambda value, within: F.min_by(F.when(F.col("within") == within, value), F.when(F.col("within") == within, F.col("rank")))
    best = seen.groupBy("class").agg(first(odds, False).alias("odds"), first(word, True).alias("word"))
    return finals.select("class").join(best, "class", "left").select("class", F.least("odds", "word").alias("log_odds"))
