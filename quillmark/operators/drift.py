"""Problem 2: schemas that drift between the files of a feed.

Every delivered file has a schema fingerprint: its field paths with their JSON types. Files of a feed are compared one by
one in order, unless their fingerprints are the same; each change of fields is recorded as an explicit migration step
(added, removed, renamed, retyped). All records are read into one table: each through the steps of its feed up to its
file, as chained renames at any depth, casts of what was retyped and defaults for what its file lacks.

Files are compared by facts of their fields (how many lines hold them, which, and what is summed over their values), one
row a field. Where fields were added, their values are compared, too: Spark counts the distinct values, and patterns of
letters and digits, that an added field shares with each field of the file before. Nothing is sampled.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.session import durable, sized, spread
from quillmark.sources import records as R

#: Score from which an added field is taken to carry on a removed one.
RENAME = 0.5

# Names under which deliveries carry the parts of a preference record; those of ``records`` come first.
ALIASES = {
    "example_id": R.IDS,
    "prompt": (*R.PROMPT, "prompt_messages", "prompt_text"),
    "chosen": (*R.CHOSEN, "preferred", "chosen_text"),
    "rejected": (*R.REJECTED, "dispreferred", "rejected_text"),
    "overall_preference": ("overall_preference", "preference", "pref_score", "preference_score"),
    "self_rubrics": R.SELF_RUBRICS,
    "reference_rubrics": R.REFERENCE_RUBRICS,
    "candidate_responses": R.CANDIDATES,
    "domain": ("domain", "subset", "category"),
    "language": ("language", "lang", "locale"),
    "role": R.ROLE,
    "content": (*R.CONTENT, "body"),
    "tags": ("tags", "labels"),
}
_GROUP = {n: g for g, names in ALIASES.items() for n in names}

_PARTS = ("example_id", "prompt", "chosen", "rejected", "overall_preference", "domain", "language")

_FACTS = "feed string, file_name string, file_seq int, path string, kind string, lines long, first_line int, last_line int, held binary, n_values long, total_length double, least double, most double, whole long"
_RUN = re.compile(r"[^\W\d_]+|\d+")


def readable(raw: str | None) -> dict[str, Any] | None:
    """The JSON object of a line, a byte order mark aside; None for blank lines, broken ones and other JSON."""
    if not raw:
        return None
    t = raw.lstrip("﻿").strip()
    if not t.startswith("{"):
        return None
    try:
        v = json.loads(t, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def kind_of(v: Any) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def fields(v: Any, path: str = "") -> Iterator[tuple[str, str, Any]]:
    """(path, kind, value) of every value other than null in a JSON object; ``a.b`` for members, ``a[]`` for elements."""
    if isinstance(v, dict):
        inner = ((f"{path}.{k}" if path else k, x) for k, x in v.items())
    else:
        inner = ((f"{path}[]", x) for x in v)
    for p, x in inner:
        kind = kind_of(x)
        if kind:
            yield p, kind, x
            if kind in ("array", "object"):
                yield from fields(x, p)


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1


def _packed(lines: list[int]) -> bytes:
    """Line numbers as compressed differences."""
    return zlib.compress(np.diff(np.unique(np.array(lines, dtype=np.int64)), prepend=0).astype(np.int32).tobytes(), 1)


def _unpacked(parts: list[bytes]) -> int:
    """The lines of all parts as the bits of one number."""
    at = [np.cumsum(np.frombuffer(zlib.decompress(p), dtype=np.int32).astype(np.int64)) for p in parts]
    bits = np.zeros(int(max(x[-1] for x in at)) + 1, dtype=bool)
    for x in at:
        bits[x] = True
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


class _Fact:
    __slots__ = ("held", "least", "length", "most", "n", "whole")

    def __init__(self):
        self.held, self.n, self.length, self.whole = [], 0, 0.0, 0
        self.least, self.most = float("inf"), float("-inf")


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _FACTS.split(", ")]
    for b in batches:
        facts: dict[tuple, _Fact] = defaultdict(_Fact)
        for feed, name, seq, line, raw in zip(b["feed"], b["file_name"], b["file_seq"], b["line_no"], b["raw_record"], strict=True):
            v = readable(raw)
            if v is None:
                continue
            for path, kind, x in fields(v):
                f = facts[feed, name, seq, path, kind]
                if not f.held or f.held[-1] != line:
                    f.held.append(line)
                f.n += 1
                if kind == "number":
                    f.least, f.most = min(f.least, x), max(f.most, x)
                    f.whole += x == int(x) if abs(x) < 1e300 else 0
                elif kind != "boolean":
                    f.length += len(x)
        rows = [(*k, len(f.held), min(f.held), max(f.held), _packed(f.held), f.n, f.length, f.least if k[4] == "number" else None, f.most if k[4] == "number" else None, f.whole) for k, f in facts.items()]
        yield pd.DataFrame(rows, columns=columns)


def _lines(records: DataFrame) -> DataFrame:
    number = lambda c: F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(0)), F.lit(0)).alias(c)
    return records.where("raw_record is not null and feed is not null and file_name is not null").select("feed", "file_name", number("file_seq"), number("line_no"), "raw_record")


def field_facts(records: DataFrame) -> DataFrame:
    """One row for each (feed, file, path, kind), from records(feed, file_name, file_seq, line_no, raw_record).

    ``held`` has the lines of the field in parts, one for each batch that a task read. Rows with a null feed, file or record
    are left out; a null or negative file_seq or line_no counts as 0.
    """
    each = spread(_lines(records)).mapInPandas(_facts, _FACTS)
    return each.groupBy("feed", "file_name", "file_seq", "path", "kind").agg(
        F.sum("lines").alias("lines"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.collect_list("held").alias("held"),
        F.sum("n_values").alias("n_values"), F.sum("total_length").alias("total_length"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("whole").alias("whole"),
    )


class _Field:
    """All that is known of a path in one file, over its kinds."""

    def __init__(self, rows: list[dict]):
        self.kinds = {r["kind"]: r for r in rows}
        self.lines = sum(r["lines"] for r in rows)
        self.first = int(min(r["first_line"] for r in rows))
        self.last = int(max(r["last_line"] for r in rows))
        self.parts = [p for r in rows for p in r["held"]]
        self._held: int | None = None

    @property
    def held(self) -> int:
        """The lines that hold the field, as bits."""
        if self._held is None:
            self._held = _unpacked(self.parts)
        return self._held


def _leaf(path: str) -> str:
    return path.rsplit(".", 1)[-1].removesuffix("[]")


def _split(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]


def name_likeness(a: str, b: str) -> float:
    """How alike two field names are, from 0 to 1; names of one alias group are the same."""
    if a in _GROUP and _GROUP[a] == _GROUP.get(b):
        return 1.0
    x, y = _split(a), _split(b)
    if "".join(x) == "".join(y):
        return 1.0
    near = difflib.SequenceMatcher(None, "".join(x), "".join(y), autojunk=False).ratio()
    both = {w for w in set(x) & set(y) if len(w) > 3}
    shared = (0.4 + 0.4 * len(both) / min(len(set(x)), len(set(y)))) if both else 0.0
    likeness = max(shared, near if near > 0.6 else 0.6 * near)
    # A name of a known part and one that isn't among its names.
    return 0.5 * likeness if (a in _GROUP) != (b in _GROUP) else likeness


def value_likeness(old: _Field, new: _Field, alike: dict[tuple[str, bool], float]) -> float | None:
    """How alike the values of two fields are, from 0 to 1; None if they share no kind.

    ``alike`` has, for each kind, the share of the values and of the patterns of the one with fewer that the other has, too.
    """
    scores = []
    for kind in old.kinds.keys() & new.kinds.keys():
        a, b = old.kinds[kind], new.kinds[kind]
        if kind == "string":
            la, lb = a["total_length"] / max(1, a["n_values"]), b["total_length"] / max(1, b["n_values"])
            size = min(la, lb) / max(la, lb, 1e-9) if max(la, lb) else 1.0
            shared, pattern = alike.get((kind, False), 0.0), alike.get((kind, True), 0.0)
            scores.append(max(shared, 0.75 * pattern * size, 0.6 * size if min(la, lb) > 40 else 0.25 * size))
        elif kind == "number":
            lo, hi = min(a["least"], b["least"]), max(a["most"], b["most"])
            inner = min(a["most"], b["most"]) - max(a["least"], b["least"])
            span = max(0.0, inner) / (hi - lo) if hi > lo else 1.0
            whole = 1 - abs(a["whole"] / max(1, a["n_values"]) - b["whole"] / max(1, b["n_values"]))
            # Fractions seldom repeat; that both have some is likeness enough.
            broken = 0.6 if max(a["whole"] / max(1, a["n_values"]), b["whole"] / max(1, b["n_values"])) < 0.95 else 0.0
            scores.append(whole**2 * (0.5 * span + 0.5 * max(broken, alike.get((kind, False), 0.0))))
        elif kind == "boolean":
            scores.append(0.4)
        else:
            la, lb = a["total_length"] / max(1, a["n_values"]), b["total_length"] / max(1, b["n_values"])
            scores.append(0.5 * (min(la, lb) / max(la, lb) if max(la, lb) else 1.0))
    return max(scores) if scores else None


class _File:
    def __init__(self, rows: list[dict]):
        by_path = defaultdict(list)
        for r in rows:
            by_path[r["path"]].append(r)
        self.fields = {p: _Field(r) for p, r in by_path.items()}
        self.inner: dict[str, list[str]] = defaultdict(list)
        for p in self.fields:
            if not p.endswith("[]"):
                self.inner[p.rpartition(".")[0]].append(p)
        self.n = max((f.lines for f in self.fields.values()), default=0)


def _over(old: _Field, new: _Field) -> bool:
    """Whether, in one file, the old field's lines end where the new one's begin."""
    n_old, n_new = old.held.bit_count(), new.held.bit_count()
    if (old.held & new.held).bit_count() > 0.05 * min(n_old, n_new):
        return False
    late = (old.held >> (new.first + 1)).bit_count() / n_old
    early = (new.held & ((1 << old.last) - 1)).bit_count() / n_new
    return late <= 0.1 or early <= 0.1


def compare(before: _File, after: _File, alike: dict[tuple[str, str], dict[tuple[str, bool], float]]) -> Iterator[tuple[str, str, str]]:
    """(change, field, new_field) between two files of a feed; ``alike``: what their (old path, new path) share, see ``value_likeness``."""

    def pair(old: str, new: str) -> Iterator[tuple[str, str, str]]:
        a, b = before.fields.get(old), after.fields.get(new)
        if a is None or b is None:
            return
        if b.kinds.keys() - a.kinds.keys():
            yield "retyped", old, new
        if "object" in a.kinds and "object" in b.kinds:
            yield from members(old, new)
        if "array" in a.kinds and "array" in b.kinds:
            yield from pair(f"{old}[]", f"{new}[]")

    def rate(f: _Field, file: _File, parent: str, since: int | None = None) -> float:
        whole = file.fields[parent].lines if parent in file.fields else file.n
        if since is not None and (span := [x for x in file.fields.values() if x.last >= since]):
            held = 0
            for y in span:
                held |= y.held
            whole *= (held >> since).bit_count() / held.bit_count()
        return min(1.0, f.lines / max(1.0, whole))

    def members(old_parent: str, new_parent: str) -> Iterator[tuple[str, str, str]]:
        old = {p[len(old_parent) + 1 if old_parent else 0 :]: p for p in before.inner[old_parent]}
        new = {p[len(new_parent) + 1 if new_parent else 0 :]: p for p in after.inner[new_parent]}
        added, removed = [k for k in new if k not in old], [k for k in old if k not in new]
        scored = []
        for k in added:
            q = after.fields[new[k]]
            for j in old:
                stays = j in new
                if stays and not _over(after.fields[new[j]], q):
                    continue
                p = before.fields[old[j]]
                value = value_likeness(p, q, alike.get((old[j], new[k]), {}))
                if value is None:
                    continue
                name = name_likeness(j, k)
                near = 1 - abs(rate(p, before, old_parent) - rate(q, after, new_parent, q.first if stays else None))
                score = 0.45 * name + 0.4 * value + 0.15 * near
                # One that ends in this file just where the other begins is likelier to be carried on.
                clean = stays and min(after.fields[new[j]].held.bit_count(), q.held.bit_count()) >= 3
                if score >= RENAME - 0.04 * clean + 0.06 * (stays and not clean):
                    scored.append((score, j, k))
        taken: dict[str, str] = {}
        used = set()
        for _, j, k in sorted(scored, reverse=True):
            if j not in used and k not in taken:
                taken[k] = j
                used.add(j)
        for k in added:
            if k in taken:
                yield "renamed", old[taken[k]], new[k]
                yield from (c for c in pair(old[taken[k]], new[k]) if c[0] != "retyped" or c[1] != old[taken[k]])
            else:
                yield "added", new[k], new[k]
        for k in removed:
            if k not in used:
                yield "removed", old[k], old[k]
        for k in old:
            if k in new:
                yield from pair(old[k], new[k])

    yield from members("", "")


_CHANGES = "feed string, file_name string, file_seq int, change string, field string, new_field string"


def _compare_group(key: tuple, facts: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    feed, name, seq = key
    rows = facts.to_dict("records")
    before, after = _File([r for r in rows if r["before"]]), _File([r for r in rows if not r["before"]])
    alike: dict[tuple[str, str], dict[tuple[str, bool], float]] = defaultdict(dict)
    for r in shared.to_dict("records"):
        alike[r["old_path"], r["new_path"]][r["kind"], r["pattern"]] = r["n"] / min(r["n_old"], r["n_new"])
    got = list(compare(before, after, alike)) if before.fields and after.fields else []
    return pd.DataFrame([(feed, name, seq, *c) for c in got], columns=[c.split()[0] for c in _CHANGES.split(", ")])


def _fingerprint(path: Column | str = "path", kind: Column | str = "kind") -> Column:
    return F.sha2(F.concat_ws("\n", F.array_sort(F.collect_set(F.concat_ws(" ", path, kind)))), 256)


def consecutive(facts: DataFrame) -> DataFrame:
    """(feed, file_name, file_seq, before_name, added): files whose fingerprint differs from that of the file before, and their new paths."""
    files = facts.groupBy("feed", "file_name", "file_seq").agg(_fingerprint().alias("fingerprint"), F.collect_set("path").alias("paths"))
    w = W.partitionBy("feed").orderBy("file_seq", "file_name")
    prior = files.withColumns({f"before_{c}": F.lag(c).over(w) for c in ("file_name", "fingerprint", "paths")})
    return prior.where("fingerprint <> before_fingerprint").select("feed", "file_name", "file_seq", F.col("before_file_name").alias("before_name"), F.array_except("paths", "before_paths").alias("added"), "before_paths")


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feed, file_name, path, kind, pattern, value): hashes of the strings and numbers, and patterns of the strings, of the wanted paths."""
    for b in batches:
        got: set[tuple] = set()
        for feed, name, raw, paths in zip(b["feed"], b["file_name"], b["raw_record"], b["paths"], strict=True):
            v, wanted = readable(raw), set(paths)
            if v is None:
                continue
            for path, kind, x in fields(v):
                if path not in wanted:
                    continue
                if kind == "string":
                    got.add((feed, name, path, kind, False, _hash(x)))
                    got.add((feed, name, path, kind, True, _hash(_RUN.sub(lambda m: "0" if m.group()[0].isdigit() else "a", x))))
                elif kind == "number":
                    got.add((feed, name, path, kind, False, _hash(repr(float(x)))))
        yield pd.DataFrame(list(got), columns=["feed", "file_name", "path", "kind", "pattern", "value"])


def shared_values(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feed, file_name, file_seq, old_path, new_path, kind, pattern, n, n_old, n_new): distinct values that an added path shares with one of the file before.

    Only the files of ``pairs`` (see ``consecutive``) with added paths are read again, and only these paths of them.
    """
    drifted = pairs.where(F.size("added") > 0)
    paths = drifted.select("feed", "file_name", F.col("added").alias("p")).unionByName(drifted.select("feed", F.col("before_name").alias("file_name"), F.col("before_paths").alias("p")))
    wanted = durable(paths.groupBy("feed", "file_name").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("paths")))
    each = _lines(records).join(sized(wanted), ["feed", "file_name"])
    values = durable(spread(each).select("feed", "file_name", "raw_record", "paths").mapInPandas(_values, "feed string, file_name string, path string, kind string, pattern boolean, value long").distinct())
    counts = values.groupBy("feed", "file_name", "path", "kind", "pattern").agg(F.count("*").alias("n"))
    keys = ["feed", "file_name", "file_seq", "kind", "pattern"]
    of_new = durable(drifted.select("feed", "file_name", "file_seq", F.explode("added").alias("path")))
    of_old = durable(drifted.select("feed", "file_name", "file_seq", F.col("before_name")))
    new = lambda v: v.join(sized(of_new), ["feed", "file_name", "path"]).withColumnRenamed("path", "new_path")
    old = lambda v: v.withColumnsRenamed({"file_name": "before_name", "path": "old_path"}).join(sized(of_old), ["feed", "before_name"]).drop("before_name")
    met = new(values).join(old(values), [*keys, "value"]).groupBy(*keys, "old_path", "new_path").agg(F.count("*").alias("n"))
    return met.join(new(counts.withColumnRenamed("n", "n_new")), [*keys, "new_path"]).join(old(counts.withColumnRenamed("n", "n_old")), [*keys, "old_path"])


def changes(facts: DataFrame, records: DataFrame) -> DataFrame:
    """(feed, file_name, file_seq, change, field, new_field) for consecutive files of each feed, from ``field_facts`` of ``records``.

    A file without a readable object has no fields to compare and is passed over. The end of a name that was renamed in an
    earlier file, where both names were met, is no further change. ``facts`` is read more than once: keep it.
    """
    pairs = durable(consecutive(facts))
    keys = ["feed", "file_name", "file_seq"]
    older = facts.drop("file_seq").withColumnRenamed("file_name", "before_name").join(pairs.select(*keys, "before_name"), ["feed", "before_name"]).drop("before_name").withColumn("before", F.lit(True))
    newer = facts.join(pairs.select(*keys), keys).withColumn("before", F.lit(False))
    both = older.unionByName(newer).groupBy(*keys)
    raw = both.cogroup(shared_values(records, pairs).groupBy(*keys)).applyInPandas(_compare_group, _CHANGES)
    # A name's last event before its removal tells whether it was renamed while it was still met.
    w = W.partitionBy("feed", "field").orderBy("file_seq", "file_name").rowsBetween(W.unboundedPreceding, -1)
    was = F.last(F.when(F.col("change").isin("renamed", "added"), F.col("change")), ignorenulls=True).over(w)
    return raw.withColumn("was", was).where("not (change = 'removed' and coalesce(was, '') = 'renamed')").drop("was")


def versions(facts: DataFrame) -> DataFrame:
    """(feed, file_name, file_seq, fingerprint, version, n_fields): the schema of each file; the version counts the changes of fingerprint in the feed."""
    each = facts.groupBy("feed", "file_name", "file_seq").agg(_fingerprint().alias("fingerprint"), F.count_distinct("path").alias("n_fields"))
    w = W.partitionBy("feed").orderBy("file_seq", "file_name")
    new = F.coalesce((F.col("fingerprint") != F.lag("fingerprint").over(w)).cast("int"), F.lit(1))
    return each.withColumn("new", new).withColumn("version", F.sum("new").over(w).cast("int")).drop("new")


def steps(found: DataFrame) -> DataFrame:
    """(feed, steps): for each feed its migration steps in order, as an array of (file_seq, change, field, new_field)."""
    return found.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("file_seq", "change", "field", "new_field"))).alias("steps"))


class Migration:
    """What the steps of a feed do to the records of the file ``seq``: names to their first ones, casts and defaults, by path."""

    def __init__(self, all_steps: list[tuple[int, str, str, str]], seq: int):
        self.first: dict[str, str] = {}  # by the first name of the parent and the name in the file
        self.cast: set[str] = set()
        lacks: dict[str, bool] = {}
        for at, change, old, new in sorted(all_steps, key=lambda s: s[0]):
            if change == "renamed":
                if at <= seq:
                    parent, name = self._split(new)
                    self.first[self._join(self.path(parent), name)] = self.path(old)
            elif change == "retyped":
                self.cast.add(self.path(old if at > seq else new))
            else:
                path = self.path(new)
                # What comes later is lacking until then; what went is lacking from there on.
                if at > seq:
                    lacks.setdefault(path, change == "added")
                else:
                    lacks[path] = change == "removed"
        self.defaults: dict[str, list[str]] = defaultdict(list)
        for path, lacking in lacks.items():
            if lacking and not path.endswith("[]"):
                parent, name = self._split(path)
                if parent or _GROUP.get(name) not in _PARTS:  # those have a column, filled from any of their names
                    self.defaults[parent].append(name)

    @staticmethod
    def _split(path: str) -> tuple[str, str]:
        parent, _, name = path.rpartition(".")
        return parent, name

    @staticmethod
    def _join(parent: str, name: str) -> str:
        return f"{parent}.{name}" if parent else name

    def path(self, path: str) -> str:
        """The path of first names of a path in the file."""
        now = ""
        for name in path.split(".") if path else ():
            bare = name.rstrip("[]")
            now = self.first.get(self._join(now, bare), self._join(now, bare)) + name[len(bare) :]
        return now

    def apply(self, value: Any, done: list[str], path: str = "") -> Any:
        """``value`` under first names, with casts and defaults; ``done`` gets each step that was taken, once."""
        if path in self.cast and value is not None:
            if not isinstance(value, str):
                done.append(f"cast {path} to string")
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
            return value
        if isinstance(value, list):
            return [self.apply(x, done, f"{path}[]") for x in value]
        if not isinstance(value, dict):
            return value
        out: dict[str, Any] = {}
        named = [(k, self._split(self.first.get(self._join(path, k), self._join(path, k)))[1]) for k in value]
        # A name that is its own first one goes before one that was renamed to it.
        for k, name in sorted(named, key=lambda n: n[0] != n[1]):
            x = value[k]
            if x is None:
                continue
            if name in out:
                done.append(f"keep {self._join(path, k)} beside {self._join(path, name)}")
                name = k if k not in out else f"{k} (2)"
            elif name != k:
                done.append(f"rename {self._join(path, k)} -> {self._join(path, name)}")
            out[name] = self.apply(x, done, self._join(path, name))
        for name in self.defaults.get(path, ()):
            if name not in out:
                done.append(f"default {self._join(path, name)}")
                out[name] = None
        return out


def _messages(v: Any) -> list[dict[str, str]] | None:
    """The messages of a prompt: its own, or one of the user."""
    if isinstance(v, str):
        return [{"role": "user", "content": v}]
    if not isinstance(v, list):
        return None
    out = []
    for x in v:
        if isinstance(x, dict):
            role = next((str(x[k]) for k in ALIASES["role"] if x.get(k) is not None), "user")
            out.append({"role": role, "content": next((_text_of(x[k]) for k in ALIASES["content"] if x.get(k) is not None), None) or ""})
        elif x is not None:
            out.append({"role": "user", "content": str(x)})
    return out


def _text_of(v: Any) -> str | None:
    """A prompt or response as text: the parts of a list on lines, messages as ``role: content``."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, list):
        return "\n".join(f"{m['role']}: {m['content']}" if isinstance(x, dict) else m["content"] for x, m in zip([x for x in v if x is not None], _messages(v), strict=True))
    return json.dumps(v, ensure_ascii=False, sort_keys=True)


_TABLE = (
    "raw_id long, feed string, file_name string, version int, line_no int, example_id string, prompt_text string, prompt_messages array<struct<role:string,content:string>>, chosen_response string, rejected_response string, "
    "overall_preference double, domain string, language string, other string, rules array<string>"
)
_TABLE_COLUMNS = ("raw_id", "feed", "file_name", "version", "line_no", "example_id", "prompt_text", "prompt_messages", "chosen_response", "rejected_response", "overall_preference", "domain", "language", "other", "rules")


def _number(v: Any) -> tuple[float | None, bool]:
    if isinstance(v, bool) or v is None:
        return None, v is not None
    try:
        return float(v), isinstance(v, str)
    except (TypeError, ValueError):
        return None, True


def _migrate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple, Migration] = {}
    for b in batches:
        out = []
        for raw_id, feed, name, seq, version, line, raw, its_steps in zip(*(b[c] for c in ("raw_id", "feed", "file_name", "file_seq", "version", "line_no", "raw_record", "steps")), strict=True):
            v = readable(raw)
            if v is None:
                continue
            if (feed, seq) not in known:
                if len(known) > 1000:
                    known.clear()
                known[feed, seq] = Migration([(r["file_seq"], r["change"], r["field"], r["new_field"]) for r in its_steps] if its_steps is not None else [], seq)
            done: list[str] = []
            named = known[feed, seq].apply(v, done)
            got: dict[str, Any] = {}
            for part in _PARTS:
                at = next((n for n in ALIASES[part] if named.get(n) not in (None, "")), None)
                got[part] = named.pop(at) if at else None
                if at and at != part:
                    done.append(f"map {at} -> {part}")
                if not at and part in ("domain", "language"):
                    got[part] = "unknown"
                    done.append(f"default {part}")
            preference, cast = _number(got["overall_preference"])
            if cast:
                done.append("cast overall_preference to number")
                if preference is None:
                    named["overall_preference"] = got["overall_preference"]
            if got["example_id"] is not None and not isinstance(got["example_id"], str):
                got["example_id"] = json.dumps(got["example_id"])
                done.append("cast example_id to string")
            for part in ("prompt", "chosen", "rejected"):
                if isinstance(got[part], str) and got[part][:1] in "[{":  # a list that a cast made a string
                    try:
                        got[part] = json.loads(got[part])
                    except ValueError:
                        pass
                if got[part] is not None and not isinstance(got[part], str):
                    done.append(f"cast {part} to text")
            other = json.dumps(named, ensure_ascii=False, sort_keys=True)
            out.append((raw_id, feed, name, version, line, got["example_id"], _text_of(got["prompt"]), _messages(got["prompt"]), _text_of(got["chosen"]), _text_of(got["rejected"]), preference, _text_of(got["domain"]), _text_of(got["language"]), other, list(dict.fromkeys(done))))
        yield pd.DataFrame(out, columns=list(_TABLE_COLUMNS))


def one_table(records: DataFrame, found: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """All readable records in one schema, each through its feed's steps up to its file, then aliases, defaults and casts.

    Renamed fields come under their first names at any depth; a record that holds both names keeps both values, the second
    under its own name. A field that was retyped anywhere in the feed is a string throughout (JSON for what is no string); fields that
    other files of the feed have and this one lacks are null. ``rules`` lists what was done to a record, ``version`` counts
    the fingerprints of the feed (null without ``facts``); ``other`` holds the rest of its fields as JSON. Blank, broken and
    null lines give no row, nor do rows with a null raw_id. A response that is an array of parts becomes lines of text.
    """
    whole = F.greatest(F.coalesce(F.col("file_seq").cast("int"), F.lit(0)), F.lit(0)).alias("file_seq")
    named = records.where("raw_id is not null").select("raw_id", "feed", "file_name", whole, F.coalesce(F.col("line_no").cast("int"), F.lit(0)).alias("line_no"), "raw_record")
    named = named.join(sized(durable(steps(found))), "feed", "left")
    if facts is None:
        named = named.withColumn("version", F.lit(None).cast("int"))
    else:
        named = named.join(sized(durable(versions(facts).select("feed", "file_name", "file_seq", "version"))), ["feed", "file_name", "file_seq"], "left")
    return named.mapInPandas(_migrate, _TABLE)


def fingerprint(paths: list[tuple[str, str]]) -> str:
    """The fingerprint that ``versions`` gives for these (path, kind)."""
    return hashlib.sha256("\n".join(sorted({f"{p} {k}" for p, k in paths})).encode()).hexdigest()
