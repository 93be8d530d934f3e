"""Semi-joins whose small side is sent whole only after its rows have been counted, joins in a grid, and bitmaps of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a table of keys that is broadcast, some 8 to 16 bytes each; beyond, the join shuffles by key.
BROADCAST_ROWS = 1 << 20


def sized(small: DataFrame) -> DataFrame:
    """The durable table ``small``, to be broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def only(df: DataFrame, c: str, wanted: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``c`` is in wanted(c), or with ``how='left_anti'`` those whose ``c`` isn't.

    ``wanted`` is a durable table, so that counting it reads no more than its rows. The rows are the same either way.
    """
    return df.join(sized(wanted), c, how)


def grid(left: DataFrame, right: DataFrame, counts: DataFrame, edge: int = 2048) -> DataFrame:
    """The join (x, y) of left(key, x STRUCT) and right(key, y STRUCT) on keys that very many rows hold; both by x.class and y.class.

    ``counts`` has key and n, the rows that either side holds at most. A key's rows are dealt by hash over ceil(n / edge) rows
    and columns of a grid: each cell joins about ``edge`` by ``edge`` rows, so no key is one group.
    """
    wide = sized(counts.withColumn("cells", F.ceil(F.col("n") / F.lit(edge)).cast("int")).select("key", "cells"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    at = lambda c: F.pmod(F.xxhash64(F.col(c)["class"]), F.col("cells")).cast("int")
    rows = left.join(wide, "key").select("key", "x", at("x").alias("i"), every.alias("j")).distinct()
    columns = right.join(wide, "key").select("key", "y", at("y").alias("j"), every.alias("i")).distinct()
    return rows.join(columns, ["key", "i", "j"]).select("x", "y")


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` slots, a power of two, in which those of keys(key LONG) are set; words of 32 bits come to the driver."""
    slot = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(bits - 1)).alias("slot")
    parts = keys.select(slot).groupBy(F.shiftright("slot", 5).alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 31 as int))")).alias("bits"))
    got = parts.toPandas()
    table = np.zeros(bits // 32, dtype=np.uint32)
    table[got["part"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table.view(np.uint8)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) have their slot set in a ``bitmap``."""
    slot = (keys >> np.uint64(8)) & np.uint64(8 * len(table) - 1)
    return ((table[(slot >> np.uint64(3)).view(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
