"""Problem 7: passages of held-out test items in a corpus.

A document is affected by an item if it holds ``run`` or more consecutive words of the item's own sentences, whatever the
case, punctuation, spacing, markup or escapes between them. A sentence that several items share is no item's own.

Method: the own sentences form a BM25 inverted index with block maxima. The passages of a document are the stretches of
``run`` or more words that the index knows (any other word scores nothing and ends a run), in overlapping windows of
PASSAGE words. Each passage is a query, answered by block-max WAND: cursors over the postings of its words, moved by binary
search, whole blocks skipped whose maxima cannot reach the threshold. The threshold of an item is the least score that any
``run`` consecutive words of it give, so whatever holds such words is retrieved. Items stand in the order of their
thresholds, so that the least threshold of those still ahead rises as the cursors move. What is retrieved is verified against the item's words.

The corpus is read once, whatever the number of items: against a bitmap of the items' words it gives passages. The index is built by
Spark tasks in shards of a bounded number of words, which are broadcast one by one; where there are several, the passages
are kept and query one after the other.
"""

from __future__ import annotations

import html
import math
import pickle
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.words import code, words
from quillmark.llm.filters import bitmap
from quillmark.session import durable, spread

RUN = 12
#: Words of own sentences in one shard of the index, some 100 bytes each once built.
SHARD_WORDS = 400_000
#: Words of a passage; the next one begins PASSAGE - RUN + 1 words later, so each run lies whole in some passage.
PASSAGE = 24
#: Bits of the bitmap of the items' words; a word that it holds by chance only lengthens passages.
KNOWN = 1 << 24
_BLOCK = 32
_first = itemgetter(0)
_K1, _B = 1.2, 0.75

_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|(?<=[。！？])\s*|\n+")
_ESCAPE = re.compile(r"\\+(u[0-9a-fA-F]{4}|[nrtbf\"'/\\])")
_BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|hr|blockquote|pre|section|article)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_ESCAPED = {"n": "\n", "r": "\n", "t": "\t", "b": " ", "f": " ", '"': '"', "'": "'", "/": "/", "\\": " "}


def _unescape(m: re.Match) -> str:
    e = m.group(1)
    return chr(int(e[1:], 16)) if e[0] == "u" else _ESCAPED[e]


def readings(text: str) -> list[list[str]]:
    """The words of a text as it stands and, if it may hold escapes or markup, with these resolved."""
    got = [words(text)]
    if "\\" in text or "<" in text or "&" in text:
        t = _ESCAPE.sub(_unescape, text) if "\\" in text else text
        for _ in range(2):
            t = html.unescape(t)
        t = _ESCAPE.sub(_unescape, t)
        if (w := words(_TAG.sub("", _BREAK_TAG.sub(" ", t)))) != got[0]:
            got.append(w)
        if (w := words(_TAG.sub(" ", t))) not in got:
            got.append(w)
    return got


def _sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(i, pos, w) for i, t in zip(b["id"], b["text"], strict=True) for pos, s in enumerate(_SENTENCE.split(t)) if (w := " ".join(words(s)))]
        yield pd.DataFrame(out, columns=["id", "pos", "sentence"])


def own_sentences(items: DataFrame) -> DataFrame:
    """(id, pos, sentence) for the sentences of items(id BIGINT, text STRING) that no other item holds; sentence: its words."""
    each = items.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text").mapInPandas(_sentences, "id long, pos int, sentence string")
    shared = each.groupBy("sentence").agg(F.count_distinct("id").alias("n")).where("n > 1").select("sentence")
    return each.join(shared, "sentence", "left_anti").select("id", "pos", "sentence")


class Index:
    """A shard of the index: postings with BM25 impacts, their block maxima, each item's threshold and runs of words."""

    def __init__(self, sentences: list[tuple[int, int, str]], run: int = RUN):
        self.run = run
        by_item: dict[int, list[tuple[int, list[str]]]] = defaultdict(list)
        for i, pos, s in sentences:
            by_item[i].append((pos, s.split(" ")))
        self.items, stretches = [], []
        for i in sorted(by_item):
            parts: list[list[str]] = []
            last = None
            for pos, w in sorted(by_item[i]):
                if last is not None and pos == last + 1:
                    parts[-1].extend(w)
                else:
                    parts.append(list(w))
                last = pos
            parts = [p for p in parts if len(p) >= run]
            if parts:
                self.items.append(i)
                stretches.append(parts)
        n = len(self.items)
        bags = [defaultdict(int) for _ in self.items]
        for bag, parts in zip(bags, stretches, strict=True):
            for p in parts:
                for w in p:
                    bag[w] += 1
        length = [sum(b.values()) for b in bags]
        mean = sum(length) / n if n else 1.0
        df: dict[str, int] = defaultdict(int)
        for b in bags:
            for w in b:
                df[w] += 1
        impacts: list[dict[str, float]] = []
        for x, b in enumerate(bags):
            norm = _K1 * (1 - _B + _B * length[x] / mean)
            impacts.append({w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (_K1 + 1) / (tf + norm) for w, tf in b.items()})
        grams = [[p[k : k + run] for p in parts for k in range(len(p) - run + 1)] for parts in stretches]
        least = [min(math.fsum(imp[w] for w in set(g)) for g in gs) - 1e-9 for imp, gs in zip(impacts, grams, strict=True)]
        # Items in the order of their thresholds.
        order = sorted(range(n), key=lambda x: (least[x], self.items[x]))
        self.items = [self.items[x] for x in order]
        self.threshold = [least[x] for x in order]
        self.runs = [frozenset(map(gram_code, grams[x])) for x in order]
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for at, x in enumerate(order):
            for w, v in impacts[x].items():
                lists[w].append((at, v))
        #: Of each word its items, their impacts, the last item and greatest impact of each block, and the greatest of all.
        self.postings: dict[str, tuple[list[int], list[float], list[int], list[float], float]] = {}
        for w, post in lists.items():
            at, v = [p[0] for p in post], [p[1] for p in post]
            blocks = range(0, len(v), _BLOCK)
            self.postings[w] = (at, v, [at[min(k + _BLOCK, len(at)) - 1] for k in blocks], [max(v[k : k + _BLOCK]) for k in blocks], max(v))

    def retrieve(self, query: set[str]) -> list[int]:
        """Positions of the items that score their threshold or more for the passage's words, by block-max WAND."""
        found = []
        threshold, end = self.threshold, len(self.items)
        cursors = [[p[0][0], 0, p] for w in query if (p := self.postings.get(w))]
        while cursors:
            cursors.sort(key=_first)
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += c[2][4]
                if bound >= threshold[c[0]]:
                    pivot = k
                    break
            if pivot is None:
                break
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            # What the blocks around the pivot allow; if too little, all of them up to the first one's end are passed over.
            block_bound, goal = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
            for c in cursors[: pivot + 1]:
                _, _, lasts, maxima, _ = c[2]
                k = bisect_left(lasts, at)
                if k < len(lasts):
                    block_bound += maxima[k]
                    goal = min(goal, lasts[k] + 1)
            if block_bound >= threshold[at]:
                if cursors[0][0] == at:
                    if math.fsum(c[2][1][c[1]] for c in cursors[: pivot + 1]) >= threshold[at]:
                        found.append(at)
                    goal = at + 1
                else:
                    goal = at
            goal = max(goal, at) if block_bound >= threshold[at] else max(goal, at + 1)
            live = cursors[pivot + 1 :]
            for c in cursors[: pivot + 1]:
                ids = c[2][0]
                c[1] = bisect_left(ids, goal, c[1])
                if c[1] < len(ids):
                    c[0] = ids[c[1]]
                    live.append(c)
            cursors = live
        return found

    def leaked(self, stretch: list[str]) -> set[int]:
        """Ids of the items of which a stretch of words holds a run."""
        got: set[int] = set()
        run = self.run
        for lo in range(0, max(1, len(stretch) - run + 1), PASSAGE - run + 1):
            passage = stretch[lo : lo + PASSAGE]
            hits = [x for x in self.retrieve(set(passage)) if self.items[x] not in got]
            if hits:
                grams = {gram_code(passage[k : k + run]) for k in range(len(passage) - run + 1)}
                got.update(self.items[x] for x in hits if not grams.isdisjoint(self.runs[x]))
        return got


def gram_code(gram: list[str]) -> int:
    """64-bit code of consecutive words."""
    return xxhash.xxh3_64_intdigest(" ".join(gram).encode("utf-8", "surrogatepass"))


class _Known(dict):
    """Whether a word's slot is set in the bitmap of the items' words; forgets everything when it holds ``limit`` words."""

    def __init__(self, table: np.ndarray, limit: int = 500_000):
        super().__init__()
        self.table, self.limit = table, limit

    def __missing__(self, word: str) -> bool:
        if len(self) >= self.limit:
            self.clear()
        slot = ((code(word) & 0xFFFFFFFFFFFFFFFF) >> 8) & (8 * len(self.table) - 1)
        known = self[word] = bool(self.table[slot >> 3] >> (slot & 7) & 1)
        return known


def stretches(read: list[str], known: _Known, run: int) -> Iterator[list[str]]:
    """The longest stretches of ``run`` or more words that are all known."""
    if len(read) < run:
        return
    flags = np.fromiter(map(known.__getitem__, read), dtype=bool, count=len(read))
    breaks = np.concatenate(([-1], np.flatnonzero(~flags), [len(read)]))
    for k in np.flatnonzero(np.diff(breaks) > run):
        yield read[breaks[k] + 1 : breaks[k + 1]]


def _passages(held, run: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Known(held.value)
        for b in batches:
            out = [(d, " ".join(s)) for d, t in zip(b["id"], b["text"], strict=True) for read in readings(t) for s in stretches(read, known, run)]
            yield pd.DataFrame(out, columns=["id", "stretch"])

    return step


def _shard(run: int):
    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        index = Index(list(zip(pdf["id"].tolist(), pdf["pos"].tolist(), pdf["sentence"].tolist(), strict=True)), run)
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(index, protocol=5)]})

    return step


def _search(held):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index: Index = pickle.loads(held.value)
        for b in batches:
            out = [(d, i) for d, t in zip(b["id"], b["stretch"], strict=True) for i in sorted(index.leaked(t.split(" ")))]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    return step


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Pairs (doc_id, item_id) of documents(id, text) that hold passages of items(id, text).

    Null and empty texts leak nothing, and rows with a null id are left out. Rows that repeat an id are joined to one pair. Without items the result is empty.
    Other columns are ignored.
    """
    spark = documents.sparkSession
    own = durable(own_sentences(items))
    word = own.select("id", F.explode(F.split("sentence", " ")).alias("word"))
    table = bitmap(word.select(F.xxhash64("word").alias("key")), KNOWN)
    shards = max(1, math.ceil(word.count() / shard_words))
    built = durable(own.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_shard(run), "shard int, index binary"))
    texts = documents.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    passages = spread(texts).mapInPandas(_passages(spark.sparkContext.broadcast(table), run), "id long, stretch string")
    if shards > 1:
        passages = durable(passages)
    result = spark.createDataFrame([], "doc_id long, item_id long")
    for k in range(shards):
        for row in built.where(F.col("shard") == k).collect():  # one row, the index of about shard_words words
            result = result.unionAll(passages.mapInPandas(_search(spark.sparkContext.broadcast(row["index"])), "doc_id long, item_id long"))
    return result.distinct()


def report(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, n_documents) for the test items that leaked."""
    return leaks(documents, items, run).groupBy("item_id").agg(F.count("*").alias("n_documents"))
