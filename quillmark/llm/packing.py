"""Problem 6: texts laid into containers of fixed capacity.

Sizes are tokens of a public tokenizer. A text is split only if it exceeds the capacity: it fills whole containers, and
what is left is an item like any other.

Method: swap-based local search. Items are dealt by hash into shards of a bounded number. In a shard, items are first laid
best fit, largest first; then the emptiest container gives its items away, by moves and by exchanges of one for one or two
for one with other containers, each of which must raise the sum of squared fills, until it is empty or nothing helps. The
items of containers that stay underfull are dealt anew, over fewer shards, for another round.
"""

from __future__ import annotations

import bisect
import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import durable, spread

#: Items of a shard on average; what one task packs at once.
SHARD_ITEMS = 4096
#: Containers filled less than this are packed anew in the next round.
UNDERFULL = 0.97
ROUNDS = 3
#: Partners that an exchange is tried with, the fullest first; a bound on effort, not on the items.
_TRIES = 64
#: Times that all underfull containers of a shard are tried while something still changes.
_ROUNDS = 8


def vocabulary() -> str:
    """The tokenizer's ranks: QUILLMARK_VOCABULARY, else the installed collection of public tokenizers."""
    return os.environ.get("QUILLMARK_VOCABULARY") or "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: Fixed value: the published pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _encoder(vocabulary: bytes):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizes(held):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(held.value).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tokens": [len(encode(t)) for t in b["text"]]})

    return step


def sizes(df: DataFrame, path: str | None = None) -> DataFrame:
    """(id, tokens) of df(id BIGINT, text STRING); null texts and ids have no row, empty texts 0 tokens.

    The vocabulary is read where the query is started, and sent to the tasks; it may have 64 MB at most.
    """
    with open(path or vocabulary(), "rb") as f:
        ranks = f.read(64 * 2**20 + 1)
    if len(ranks) > 64 * 2**20:
        raise ValueError("the vocabulary has more than 64 MB")
    texts = df.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    return spread(texts).mapInPandas(_sizes(df.sparkSession.sparkContext.broadcast(ranks)), "id long, tokens long")


def pack(items: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``items`` (sizes from 1 to ``capacity``), for the items of one shard."""
    gaps: list[tuple[int, int]] = []  # (room, container), sorted
    fill: list[int] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(items)), key=lambda k: -items[k]):
        at = bisect.bisect_left(gaps, (items[i], -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
            bins[b].append(i)
            fill[b] += items[i]
        else:
            b = len(bins)
            bins.append([i])
            fill.append(items[i])
        if fill[b] < capacity:
            bisect.insort(gaps, (capacity - fill[b], b))

    def put(b: int, new: int) -> None:
        if fill[b] < capacity:
            gaps.pop(bisect.bisect_left(gaps, (capacity - fill[b], b)))
        fill[b] = new
        if new < capacity:
            bisect.insort(gaps, (capacity - new, b))

    stuck: set[int] = set()
    empty: set[int] = set()
    fresh = False  # whether something changed since all containers were last tried
    rounds = 0
    while True:
        low = next((g for g in reversed(gaps) if g[1] not in stuck), None)
        if low is None:
            if not fresh or rounds == _ROUNDS:
                break
            stuck, fresh, rounds = set(empty), False, rounds + 1
            continue
        source = low[1]
        changed = False
        for i in sorted(bins[source], key=lambda k: -items[k]):
            s = items[i]
            at = bisect.bisect_left(gaps, (s, -1))
            while at < len(gaps) and gaps[at][1] == source:
                at += 1
            if at < len(gaps) and fill[b := gaps[at][1]] + s > fill[source]:  # a move
                put(b, fill[b] + s)
                put(source, fill[source] - s)
                bins[source].remove(i)
                bins[b].append(i)
                changed = True
                continue
            for room, b in gaps[:_TRIES]:
                if b == source or fill[b] < fill[source]:
                    continue
                # One for one: j goes to the source, i comes; the target must gain, by no more than its room.
                j = max((k for k in bins[b] if s - room <= items[k] < s), key=lambda k: -items[k], default=None)
                if j is not None:
                    gain = s - items[j]
                    put(b, fill[b] + gain)
                    put(source, fill[source] - gain)
                    bins[b].remove(j)
                    bins[source].remove(i)
                    bins[b].append(i)
                    bins[source].append(j)
                    changed = True
                    break
                # Two for one: i and another item of the source for one larger item of the target.
                pair = next(((h, j) for h in bins[source] if h != i for j in bins[b] if 0 < s + items[h] - items[j] <= room), None)
                if pair:
                    h, j = pair
                    gain = s + items[h] - items[j]
                    put(b, fill[b] + gain)
                    put(source, fill[source] - gain)
                    bins[b].remove(j)
                    bins[source].remove(i)
                    bins[source].remove(h)
                    bins[b].extend((i, h))
                    bins[source].append(j)
                    changed = True
                    break
            if changed:
                break
        if not bins[source]:
            gaps.pop(bisect.bisect_left(gaps, (capacity - fill[source], source)))
            stuck.add(source)
            empty.add(source)
            fresh = True
        elif changed:
            fresh = True
        else:
            stuck.add(source)
    return [b for b in bins if b]


def _pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "part"], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity_tokens"].iloc[0])
    number = pd.Series(0, index=pdf.index)
    full = pd.Series(0, index=pdf.index)
    for n, b in enumerate(pack(pdf["tokens"].tolist(), capacity)):
        number.iloc[b] = n
        full.iloc[b] = int(pdf["tokens"].iloc[b].sum())
    first = pdf.groupby(number)[["id", "part"]].transform("first")
    return pdf.assign(container_id=[f"{w}-{i}-{p}" for w, i, p in zip(pdf["window_name"], first["id"], first["part"], strict=True)], fill=full)[list(_PACKED)]


_PACKED = {"window_name": "string", "capacity_tokens": "long", "container_id": "string", "id": "long", "part": "long", "tokens": "long", "fill": "long"}
_PACKED_DDL = ", ".join(f"{k} {v}" for k, v in _PACKED.items())


def containers(sized: DataFrame, windows: DataFrame, shard_items: int = SHARD_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """One row (window_name, capacity_tokens, container_id, id, part, tokens, fill) for each item in each kind of container.

    ``sized`` has id BIGINT (unique) and tokens BIGINT, ``windows`` window_name STRING and capacity_tokens INT, at most
    1,000 rows. An item of more tokens than the capacity is cut into parts 0, 1, ... of which all but the last fill a
    container; items of no tokens lie in none. fill is the sum of the container's tokens. container_id names the window and
    the container's first item. Capacities that are null or below 1 raise an error.
    """
    kinds = windows.select("window_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).limit(1001).collect()
    if len(kinds) > 1000 or any(not r["capacity_tokens"] or r["capacity_tokens"] < 1 for r in kinds):
        raise ValueError("windows: at most 1,000 rows, with capacities of 1 or more")
    if not kinds:
        return sized.sparkSession.createDataFrame([], _PACKED_DDL)
    listed = F.array(*(F.struct(F.lit(r["window_name"]).alias("window_name"), F.lit(r["capacity_tokens"]).alias("capacity_tokens")) for r in kinds))
    items = sized.where("tokens > 0").select("id", "tokens", F.explode(listed).alias("w")).select("w.*", "id", "tokens")
    parts = F.sequence(F.lit(0), (F.ceil(F.col("tokens") / F.col("capacity_tokens")) - 1).cast("long"))
    items = items.withColumn("part", F.explode(parts)).withColumn("tokens", F.least("capacity_tokens", F.col("tokens") - F.col("part") * F.col("capacity_tokens")))
    items = durable(items)
    whole = items.where("tokens = capacity_tokens").select("window_name", "capacity_tokens", F.format_string("%s-%d-%d", "window_name", "id", "part").alias("container_id"), "id", "part", "tokens", F.col("tokens").alias("fill"))
    done, left = whole, items.where("tokens < capacity_tokens").select("window_name", "capacity_tokens", "id", "part", "tokens")
    for n in range(rounds):
        most = left.groupBy("window_name").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
        shards = max(1, math.ceil(most / shard_items))
        dealt = left.withColumn("shard", F.pmod(F.xxhash64("id", "part", F.lit(n)), F.lit(shards)))
        packed = durable(dealt.groupBy("window_name", "shard").applyInPandas(_pack_shard, _PACKED_DDL))
        if n == rounds - 1 or shards == 1:
            return done.unionByName(packed)
        full = F.col("fill") >= F.ceil(F.col("capacity_tokens") * UNDERFULL)
        done, left = done.unionByName(packed.where(full)), packed.where(~full).select("window_name", "capacity_tokens", "id", "part", "tokens")
    return done


def summary(packed: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, n_items, n_containers, least_possible, mean_fill) of the containers."""
    each = packed.groupBy("window_name", "capacity_tokens", "container_id").agg(F.count("*").alias("n"), F.max("fill").alias("fill"))
    return each.groupBy("window_name", "capacity_tokens").agg(
        F.sum("n").alias("n_items"),
        F.count("*").alias("n_containers"),
        F.ceil(F.sum("fill") / F.first("capacity_tokens")).alias("least_possible"),
        F.round(F.avg(F.col("fill") / F.col("capacity_tokens")), 6).alias("mean_fill"),
    )
