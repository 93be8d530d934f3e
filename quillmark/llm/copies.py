"""Problem 4: records that are the same but for their dress.

Two texts are the same if their letters and digits, read in order, are the
same; the members of a JSON object and the fields of labelled text
(``label: value | label: value``) may stand in any order.

Method: canonical records are range-partitioned by (key, id) and sorted within
the partitions by Spark's external sort; each sorted partition is then scanned
once, comparing full keys of adjacent rows. Since the id takes part in the range,
one key that holds a third of all rows is spread over many partitions. Runs that
touch a partition's edge, at most two a partition, are merged afterwards by key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.words import words
from quillmark.session import durable, parallelism, spread

_LABEL_MAX = 40


def _letters(text: str) -> str:
    return "".join(words(text))


def _value(v: object) -> str:
    if isinstance(v, str):
        return _letters(v)
    if isinstance(v, dict):
        return "\x1e".join(sorted(_letters(k) + _value(x) for k, x in v.items()))
    if isinstance(v, list):
        return "".join(map(_value, v))
    return _letters(json.dumps(v))


def _fields(text: str) -> list[str] | None:
    """The fields of labelled text, or None if ``text`` is no such text."""
    parts = [p.strip() for p in text.split("|")]
    parts = [p for p in parts if p]
    if len(parts) < 2:
        return None
    for p in parts:
        label, colon, _ = p.partition(":")
        if not colon or not 0 < len(label.strip()) <= _LABEL_MAX or not label.strip()[0].isalpha():
            return None
    return parts


def canonical(text: str | None) -> str | None:
    """The key of a text: its letters and digits; for a JSON object or labelled text, those of each member, sorted.

    None for a null text; "" for one without letters and digits.
    """
    if text is None:
        return None
    t = text.lstrip("﻿ \t\r\n")
    if t.startswith("{"):
        try:
            v = json.loads(t)
        except (ValueError, RecursionError):
            v = None
        if isinstance(v, dict):
            return "\x1f".join(sorted(_letters(k) + _value(x) for k, x in v.items()))
    if "|" in t and (parts := _fields(t)):
        return "\x1f".join(sorted(map(_letters, parts)))
    return _letters(text)


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"scope": b["scope"], "key": [canonical(t) for t in b["text"]], "id": b["id"]})


def _digest(scope: str, key: str) -> bytes:
    return hashlib.sha256(f"{scope}\x00{key}".encode("utf-8", "surrogatepass")).digest()


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over a sorted partition; a run is a stretch of rows with equal (scope, key).

    Gives (scope, kept_id, copy_id, edge) for each row; ``edge`` is a digest of the key in the partition's first and
    last run, whose kept_id may lie in another partition, and null elsewhere. Inner runs of one row are included.
    """
    held: pd.DataFrame | None = None  # the last run so far, of which more may come
    held_key: tuple[str, str] | None = None
    first_key: tuple[str, str] | None = None
    kept = 0

    def edge_rows(rows: pd.DataFrame, key: tuple[str, str]) -> pd.DataFrame:
        return rows.assign(edge=[_digest(*key)] * len(rows))

    for b in batches:
        if b.empty:
            continue
        scope, key = b["scope"].to_numpy(), b["key"].to_numpy()
        new = pd.Series(scope != pd.Series(scope).shift()) | pd.Series(key != pd.Series(key).shift())
        new.iloc[0] = held_key != (scope[0], key[0])
        if first_key is None:
            first_key = (scope[0], key[0])
        run = new.cumsum()
        start = b["id"].where(new.to_numpy()).ffill()
        if not new.iloc[0]:
            start = start.fillna(kept)
        rows = pd.DataFrame({"scope": scope, "kept_id": start.astype("int64").to_numpy(), "copy_id": b["id"].to_numpy(), "edge": None})
        last = run.iloc[-1]
        tail = (run == last).to_numpy()
        continues = last == run.iloc[0] and not new.iloc[0]
        if held is not None and not continues:  # the held run is over
            if held_key == first_key:
                yield edge_rows(held, held_key)
            else:
                yield held
            held = None
        body = rows[~tail]
        if len(body):
            at_first = [(s, k) == first_key for s, k in zip(scope[~tail], key[~tail], strict=True)] if (scope[0], key[0]) == first_key else None
            if at_first is not None and any(at_first):
                mask = pd.Series(at_first, index=body.index)
                yield edge_rows(body[mask], first_key)
                body = body[~mask]
            if len(body):
                yield body
        key_now = (scope[-1], key[-1])
        if held is not None and continues:  # a long run: what is held can go, as an edge if the run proves to be one
            held = pd.concat([held, rows[tail]])
            if len(held) > 100_000:  # its edge digest is given early; the merge below is right for inner runs, too
                yield edge_rows(held.iloc[:-1], key_now)
                held = held.iloc[-1:]
        else:
            held = rows[tail]
        held_key, kept = key_now, int(rows["kept_id"].iloc[-1])
    if held is not None:
        yield edge_rows(held, held_key)


def _runs(df: DataFrame) -> DataFrame:
    """(scope, kept_id, copy_id) for every row with a key, the kept row included, from df(scope, id, text)."""
    keyed = spread(df.where("id is not null and scope is not null").select("scope", F.col("id").cast("long").alias("id"), "text")).mapInPandas(_keys, "scope string, key string, id long").where("key is not null")
    ordered = keyed.repartitionByRange(parallelism(df.sparkSession), "scope", "key", "id").sortWithinPartitions("scope", "key", "id")
    rows = durable(ordered.mapInPandas(_scan, "scope string, kept_id long, copy_id long, edge binary"))
    # At most two digests a partition, and one for each run of more than 100,000 rows: a small join in any case.
    edges = rows.where("edge is not null").groupBy("edge").agg(F.min("kept_id").alias("first_id"))
    return rows.join(F.broadcast(edges), "edge", "left").select("scope", F.coalesce("first_id", "kept_id").alias("kept_id"), "copy_id")


def copies(df: DataFrame) -> DataFrame:
    """One row (scope, kept_id, copy_id) for each record that repeats another, from df(scope STRING, id BIGINT, text STRING).

    kept_id is the smallest id of the group. Null texts belong to no group, nor do rows with a null id or scope. Texts without letters and digits form one
    group. Rows that repeat an id are told apart only by that id, and give no row with kept_id = copy_id. Other columns
    of ``df`` are ignored. An empty input gives an empty result.
    """
    return _runs(df).where("copy_id <> kept_id")


def representatives(df: DataFrame) -> DataFrame:
    """One row (scope, kept_id, n_copies) for each distinct text, with the exact number of records that hold it."""
    return _runs(df).groupBy("scope", "kept_id").agg(F.count("*").alias("n_copies"))
