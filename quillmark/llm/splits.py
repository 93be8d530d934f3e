"""Problem 3: the same or nearly the same prompt in the training split and in an evaluation split.

Two prompts overlap if they have the same set of numbers and a word overlap (distinct words in both, divided by those in
either) of at least ``overlap``.

Method: similarity-hash bit fingerprints. A fingerprint is a string of bits, cut into blocks of 32; each word of a text
picks one block and flips one bit in it, so the Hamming distance of two fingerprints is at most the number of words that
one text has and the other lacks. For texts of n and m words with enough overlap that number is at most
(n + m)(1 - overlap)/(1 + overlap), the Hamming radius r. Cut into r + SPARE blocks, two fingerprints within the radius agree
in SPARE blocks or more. r depends on the sizes: texts are put on levels by size, each 1/overlap times the one before, and
meet on the lower of their two levels. The set of numbers, which must be equal, is part of every key.

Two texts meet on one block that they agree in, unless its key is held by more than LIMIT texts: then they meet on pairs of
such blocks, and where these are frequent too on three of them (SPARE of them agree, so no pair is lost). Keys that are
frequent still, and those of very long texts, are joined in a grid of cells, over which both sides are dealt by hash. Those
that meet are held against the radius by a second, 64-bit fingerprint, and last by their words.

Prompts with the same words form one class before the join, so a prompt that a third of all rows hold is one row in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.words import Codes, is_number, words
from quillmark.llm.filters import grid, only
from quillmark.session import durable, spread

_BITS = 32  # of a block
#: Blocks beyond the radius, and so blocks that a pair agrees in at least.
SPARE = 3
#: Texts that a key may be held by before more blocks are put together.
LIMIT = 128
#: Most blocks of a level of which pairs, and of which triples, are made; longer texts go to the grid.
PAIRED, TRIPLED = 64, 24
#: Classes that a task remembers, to give the keys of a copy no second time; forgotten when full.
_REMEMBER = 200_000
_PRINTED = pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("class", pa.int64()), ("size", pa.int32()), ("print", pa.int64()), ("words", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("lower", pa.list_(pa.int64()))])
_DDL = "id long, train boolean, class long, size int, print long, words array<long>, own array<long>, lower array<long>"


def level_starts(overlap: float, most: int) -> list[int]:
    """The least sizes of the levels: two sizes that a pair may have lie on the same or on adjacent levels."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(int(starts[-1] / overlap + 1e-9) + 1)
    return starts


def radius(overlap: float, sizes: int) -> int:
    """The most words that two texts of ``sizes`` words together may not share."""
    return int(sizes * (1 - overlap) / (1 + overlap) + 1e-9)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


def block_keys(codes: np.ndarray, numbers: int, level: int, blocks: int) -> np.ndarray:
    """Keys of the fingerprint's blocks: of (numbers, level, block, its bits). ``codes``: the other words' codes."""
    u = codes.view(np.uint64)
    block = ((u >> np.uint64(20)) % np.uint64(blocks)).astype(np.int64)
    bit = np.uint64(1) << (u % np.uint64(_BITS))
    code = np.zeros(blocks, dtype=np.uint64)
    np.bitwise_xor.at(code, block, bit)
    at = np.arange(blocks, dtype=np.uint64) + np.uint64(level * 1_000_003)
    with np.errstate(over="ignore"):
        h = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ at * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(numbers)
        h ^= h >> np.uint64(32)
    return _signed(h)


def _prints(overlap: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, starts = Codes(), level_starts(overlap, 64)
        seen: set[tuple[int, bool]] = set()
        for b in batches:
            out: list[list] = [[] for _ in _PRINTED]
            for id_, train, text in zip(*(b.column(c).to_pylist() for c in ("id", "train", "text")), strict=True):
                own = set(words(text))
                if not own:
                    continue
                size = len(own)
                if size >= starts[-1]:
                    starts = level_starts(overlap, size)
                level = int(np.searchsorted(starts, size, side="right")) - 1
                if level + 2 >= len(starts):
                    starts = level_starts(overlap, starts[-1])
                all_codes = np.sort(np.array([codes[w] for w in own], dtype=np.int64))
                number_codes = np.sort(np.array([codes[w] for w in own if is_number(w)], dtype=np.int64))
                digest = hashlib.blake2b(number_codes.tobytes(), digest_size=8).digest()
                rest = np.setdiff1d(all_codes, number_codes, assume_unique=True)
                kind = int.from_bytes(hashlib.blake2b(all_codes.tobytes(), digest_size=8).digest(), "big", signed=True)
                new = (kind, train) not in seen
                if new and len(seen) >= _REMEMBER:
                    seen.clear()
                seen.add((kind, train))
                # Keys of the text's own level, then of the one below. Within a radius of 0 there are only texts of the same words.
                keys: list[np.ndarray] = []
                for at in (level, level - 1):
                    most = radius(overlap, starts[at + 1] - 1 + starts[at + 2] - 1) if at >= 0 and new else 0
                    keys.append(block_keys(rest, int.from_bytes(digest, "big"), at, most + SPARE) if most else np.zeros(0, dtype=np.int64))
                bits = np.zeros(1, dtype=np.uint64)
                np.bitwise_xor.at(bits, np.zeros(len(all_codes), dtype=np.int64), np.uint64(1) << (all_codes.view(np.uint64) >> np.uint64(58)))
                for column, v in zip(out, (id_, train, kind, size, int(_signed(bits)[0]), all_codes, *keys), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PRINTED, strict=True)], schema=_PRINTED)

    return step


def prints(df: DataFrame, overlap: float = 0.75) -> DataFrame:
    """Fingerprints of df(id BIGINT, split STRING, text STRING). Texts without words, null ones among them, have none."""
    texts = df.where("id is not null and text is not null and split is not null").select(F.col("id").cast("long").alias("id"), (F.col("split") == "train").alias("train"), "text")
    return spread(texts).mapInArrow(_prints(overlap), _DDL).persist(StorageLevel.MEMORY_AND_DISK)


_POST = ("class", "train", "size", "print", "at_own")


def _big(posts: DataFrame, limit: int) -> DataFrame:
    """(key, n, both) of the keys of more than ``limit`` posts, and whether both kinds of split hold them; counts combine before the shuffle."""
    counts = posts.groupBy("key").agg(F.count("*").alias("n"), F.count_if("train").alias("t"))
    return durable(counts.where(F.col("n") > limit).select("key", "n", ((F.col("t") > 0) & (F.col("t") < F.col("n"))).alias("both")))


def _posts(p: DataFrame, limit: int) -> tuple[list[DataFrame], list[tuple[DataFrame, DataFrame]]]:
    """The posts of keys that ``limit`` allows, and those of keys that go to the grid with the counts of these."""
    on = lambda level, own: F.transform(level, lambda k, i: F.struct(i.alias("block"), k.alias("key"), F.size(level).alias("blocks"), F.lit(own).alias("at_own")))
    one = p.where("size(own) > 0 or size(lower) > 0").select("class", "train", "size", "print", F.explode(F.concat(on("own", True), on("lower", False))).alias("k")).select("class", "train", "size", "print", "k.*")
    split = lambda posts, big: (only(posts, "key", big.select("key"), "left_anti").select("key", *_POST), only(posts, "key", big.where("both").select("key")))
    big = _big(one, limit)
    if big.isEmpty():
        return [one.select("key", *_POST)], []
    cold, hot = split(one, big)
    cells = [(hot.where(F.col("blocks") > PAIRED).select("key", *_POST), big)]
    # The frequent blocks of each text on each level, at most PAIRED.
    of = hot.where(F.col("blocks") <= PAIRED).groupBy(*_POST, "blocks").agg(F.array_sort(F.collect_set(F.struct("block", "key"))).alias("b"))
    after = lambda i: F.slice("b", i + 2, F.size("b"))
    two = of.select(*_POST, "blocks", F.posexplode(F.col("b")["key"]).alias("i", "one"), F.col("b")["key"].alias("b")).select(*_POST, "blocks", "one", after(F.col("i")).alias("b")).select(*_POST, "blocks", "one", "b", F.posexplode("b").alias("i", "other"))
    two = two.select(*_POST, "blocks", F.xxhash64("one", "other").alias("key"), after(F.col("i")).alias("b"))
    big_two = _big(two, limit)
    cold_two, hot_two = split(two, big_two)
    if big_two.isEmpty():
        return [cold, cold_two], cells
    cells.append((hot_two.where(F.col("blocks") > TRIPLED).select("key", *_POST), big_two))
    three = hot_two.where(F.col("blocks") <= TRIPLED).select(*_POST, "key", F.explode("b").alias("third")).select(*_POST, F.xxhash64("key", "third").alias("key"))
    big_three = _big(three, limit)
    cold_three, hot_three = split(three, big_three)
    cells.append((hot_three.select("key", *_POST), big_three))
    return [cold, cold_two, cold_three], cells


def _near(met: DataFrame, overlap: float) -> DataFrame:
    """Of met(x, y), x of an evaluation split and y of train, the classes (a, b) within the radius."""
    x, y = F.col("x"), F.col("y")
    far = F.floor((x["size"] + y["size"]) * F.lit((1 - overlap) / (1 + overlap)) + F.lit(1e-9))
    good = ~x["train"] & y["train"] & (x["at_own"] | y["at_own"]) & (x["class"] != y["class"]) & (F.bit_count(x["print"].bitwiseXOR(y["print"])) <= far)
    return met.where(good).select(x["class"].alias("a"), y["class"].alias("b"))


def _in_groups(cold: list[DataFrame]) -> DataFrame:
    """Pairs (x, y) of posts of one key, which no more than a known number share: one shuffle, by key."""
    posts = cold[0]
    for more in cold[1:]:
        posts = posts.unionAll(more)
    groups = posts.repartition("key").groupBy("key").agg(F.collect_set(F.struct(*_POST)).alias("group"))
    side = lambda train: F.filter("group", lambda s: s["train"] if train else ~s["train"])
    both = groups.where(F.size("group") > 1).select(side(False).alias("x"), side(True).alias("y")).where((F.size("x") > 0) & (F.size("y") > 0))
    return both.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y"))


def met_pairs(p: DataFrame, overlap: float, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of different classes, a with a record in an evaluation split and b in train, that meet within the radius."""
    cold, cells = _posts(p, limit)
    met = _near(_in_groups(cold), overlap)
    for posts, counts in cells:
        post = F.struct(*_POST)
        met = met.unionAll(_near(grid(posts.where("not train").select("key", post.alias("x")), posts.where("train").select("key", post.alias("y")), counts), overlap))
    return met.distinct()


def class_pairs(p: DataFrame, overlap: float, limit: int = LIMIT) -> DataFrame:
    """Pairs (a, b) of classes of prompts: a has a record in an evaluation split, b one in train; a = b included."""
    met = durable(met_pairs(p, overlap, limit))
    involved = durable(met.select(F.explode(F.array("a", "b")).alias("class")).distinct())
    classes = durable(only(p.select("class", "words"), "class", involved).repartition("class").distinct())
    own = lambda s: classes.select(F.col("class").alias(s), F.col("words").alias(f"w_{s}"))
    shared = F.size(F.array_intersect("w_a", "w_b"))
    sure = met.join(own("a"), "a").join(own("b"), "b").withColumn("n", shared).where(F.col("n") >= F.lit(overlap) * (F.size("w_a") + F.size("w_b") - F.col("n")) - F.lit(1e-9))
    same = p.groupBy("class").agg(F.bool_or("train").alias("t"), F.bool_and("train").alias("only")).where("t and not only")
    return sure.select("a", "b").unionAll(same.select(F.col("class").alias("a"), F.col("class").alias("b")))


def overlaps(df: DataFrame, overlap: float = 0.75, limit: int = LIMIT) -> DataFrame:
    """Pairs (record_idx_a, record_idx_b), a < b, of one record in train and one in another split that overlap.

    ``df`` has id BIGINT, split STRING and text STRING; other columns are ignored. Rows with a null id or split or without
    words are in no pair; a repeated id counts as one record unless it stands in both kinds of split, where it gives no pair
    with itself.
    """
    p = prints(df, overlap)
    pairs = durable(class_pairs(p, overlap, limit))
    members = p.select("class", "train", "id").distinct()
    left = members.where("not train").select(F.col("class").alias("a"), F.col("id").alias("x"))
    right = members.where("train").select(F.col("class").alias("b"), F.col("id").alias("y"))
    named = pairs.join(left, "a").join(right, "b").where("x <> y")
    return named.select(F.least("x", "y").alias("record_idx_a"), F.greatest("x", "y").alias("record_idx_b")).distinct()


def report(df: DataFrame, overlap: float = 0.75) -> DataFrame:
    """Counts per (split, source, train_source): pairs, and evaluation records that some training record overlaps.

    Counted from classes, so that copies are never expanded into pairs. ``df`` has source STRING besides.
    """
    p = prints(df.select("id", "split", "text"), overlap)
    pairs = durable(class_pairs(p, overlap))
    of = df.select(F.col("id").cast("long").alias("id"), "split", "source").distinct()
    held = p.select("class", "id").distinct().join(of, "id").groupBy("class", "split", F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
    left = held.where("split <> 'train'").select(F.col("class").alias("a"), "split", "source", "n")
    right = held.where("split = 'train'").select(F.col("class").alias("b"), F.col("source").alias("train_source"), F.col("n").alias("m"))
    by_class = pairs.join(left, "a").join(right, "b").groupBy("split", "source", "train_source", "a", "n").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"))
    return by_class.groupBy("split", "source", "train_source").agg(F.sum("pairs").alias("n_pairs"), F.sum("n").alias("n_eval_records"))
