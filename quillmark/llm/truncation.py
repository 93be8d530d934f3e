"""Problem 8: texts that end before their author's text did.

Method: the backward character n-gram model of ``endings`` compares, for the final context of each value, an end with a
continuation; a value is cut if the log-odds lie below the threshold of its language and column. Broken bytes, escapes,
entities and tags at the end, and a code block, bracket, quotation or code span that was not closed, show a cut without the
model.

Thresholds are learned from ends that are none of a cut: one sentence or line end inside each text is scored as if the text
stopped there without its mark. The share of all of them under the default threshold is the share of whole texts that it
takes for cut ones; each language and column gets the log-odds that has the same share of its own inner ends under it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.words import words
from quillmark.llm import endings
from quillmark.session import spread

#: Log-odds under which a value is cut, where ``thresholds`` has none for its language and column.
THRESHOLD = -1.5
#: Values of fewer words are titles and marks, not sentences.
LEAST_WORDS = 4
#: Inner ends that a language and column must have, in all and under its threshold, for a threshold of its own.
SUPPORT, SUPPORT_UNDER = 100, 5
_INNER_END = re.compile(r"[.!?](?=\s)|[。！？؟।]|\n")
_AFTER_CLOSING = "\"'”’»)]}*_`」』）】 "


def language_tag(c: Column) -> Column:
    """The two letters of a language tag, whatever its case, blanks and region; 'und' for null and odd ones."""
    tag = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(tag.isNull() | (tag == ""), "und").otherwise(tag)


def _has_words(text: str, n: int) -> bool:
    """Whether a text has ``n`` words or more; of a long one the end tells in most cases."""
    return (len(text) > 400 and len(words(text[-400:])) >= n) or len(words(text)) >= n


def verdict(text: str) -> tuple[str, str]:
    """('cut' | 'whole' | 'open', the text without the trace of a cut): what the end of a text says by itself."""
    core, trace = endings.strip_trace(text)
    if endings.open_fence(text):
        return "cut", core
    if (trace == "hard" or endings.open_delimiter(core)) and _has_words(core, 1):
        return "cut", core
    bare = core.rstrip(_AFTER_CLOSING)
    if not bare or bare[-1] in endings.CLOSING or (trace is None and not _has_words(core, LEAST_WORDS) and not any("一" <= c <= "鿿" for c in core)):
        return "whole", core
    if core.endswith(("```", "~~~")):
        return "whole", core
    return "open", core


def inner_end(core: str, digest: bytes) -> str | None:
    """``core`` up to one of its inner ends, without the mark; which one depends on the digest alone."""
    ends = [m.start() for m in _INNER_END.finditer(core, 0, max(0, len(core) - 1))]
    if not ends:
        return None
    before = core[: ends[int.from_bytes(digest[:8], "big") % len(ends)]]
    # Only where the model sees an end too: right behind a word, not behind a blank, a quotation mark or another mark.
    if not before or before[-1].isspace() or before[-1] in _AFTER_CLOSING + endings.CLOSING or (len(words(before[-400:])) < LEAST_WORDS and not any("一" <= c <= "鿿" for c in before)):
        return None
    return before


_ENDS = "id long, column string, lang string, class binary, verdict string, keys array<long>, within array<long>, inner binary, inner_keys array<long>, inner_within array<long>"


def digest(core: str, person: bytes = b"") -> bytes:
    return hashlib.blake2b(core.encode("utf-8", "surrogatepass"), digest_size=16, person=person).digest()


def _judge(learn: bool):
    """The step from (id, column, lang, text) to _ENDS: what each end says, its contexts if it says nothing, and those of an inner end."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [verdict(t) for t in b["text"]]
            finals = iter(endings.final_keys([c for v, c in got if v == "open"]))
            keys, within = zip(*(next(finals) if v == "open" else (None, None) for v, _ in got), strict=True) if got else ((), ())
            marks = [digest(c, b"inner") if learn else None for _, c in got]
            before = [inner_end(c, m) if learn else None for (_, c), m in zip(got, marks, strict=True)]
            inner = iter(endings.final_keys([x for x in before if x]))
            inner_keys, inner_within = zip(*(next(inner) if x else (None, None) for x in before), strict=True) if got else ((), ())
            yield pd.DataFrame({
                "id": b["id"], "column": b["column"], "lang": b["lang"], "class": [digest(c) for _, c in got], "verdict": [v for v, _ in got],
                "keys": list(keys), "within": list(within), "inner": [m if x else None for m, x in zip(marks, before, strict=True)], "inner_keys": list(inner_keys), "inner_within": list(inner_within),
            })

    return step


def _learned(inner: DataFrame, odds: DataFrame, default: float) -> DataFrame:
    """(lang, column, own) of the keys with enough inner ends; log-odds are rounded, so that a key has few distinct ones."""
    scored = inner.select("lang", "column", "class").distinct().join(odds.where("log_odds is not null"), "class").select("lang", "column", F.round("log_odds", 2).alias("x"))
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    share = scored.agg(F.avg((F.col("x") < default).cast("int")).alias("share")).first()["share"] or 0.0
    limits = scored.groupBy("lang", "column").agg(F.percentile("x", F.lit(share)).alias("own"), F.count("*").alias("n"))
    return limits.where((F.col("n") >= SUPPORT) & (F.col("n") * F.lit(share) >= SUPPORT_UNDER)).select("lang", "column", F.least("own", F.lit(0.0)).alias("own"))


def truncated(df: DataFrame, thresholds: Mapping[tuple[str, str], float] | None = None, default: float = THRESHOLD, learn: bool = False) -> DataFrame:
    """One row (id, column, lang, log_odds, cut) for each non-null text of df(id BIGINT, column STRING, lang STRING, text STRING).

    ``column`` names the field or source a value comes from; ``thresholds`` maps (language, column) to log-odds; with ``learn``
    keys that it lacks get a threshold of their own from the inner ends of their texts, if these suffice. log_odds is
    null where the end of the text decides by itself. Empty texts are whole; rows with a null id are left out. Rows may repeat ids; each is judged by itself.
    """
    texts = df.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), F.coalesce("column", F.lit("")).alias("column"), language_tag(F.col("lang")).alias("lang"), "text")
    texts = spread(texts)
    judged = texts.mapInPandas(_judge(learn), _ENDS).persist(StorageLevel.MEMORY_AND_DISK)
    finals = judged.where("verdict = 'open'").select("class", "keys", "within")
    limit = F.lit(float(default))
    if learn:
        inner = judged.where("inner is not null").select("lang", "column", F.col("inner").alias("class"))
        # One pass over the judged rows for both kinds of end.
        both = F.array(F.when(F.col("verdict") == "open", F.struct("class", "keys", "within")), F.when(F.col("inner").isNotNull(), F.struct(F.col("inner").alias("class"), F.col("inner_keys").alias("keys"), F.col("inner_within").alias("within"))))
        ends = judged.select(F.explode(both).alias("e")).where("e is not null").select("e.*")
        odds = endings.log_odds(texts, ends).persist(StorageLevel.MEMORY_AND_DISK)
        limit = F.coalesce("own", limit)
        judged = judged.join(_learned(inner, odds, default), ["lang", "column"], "left")
    else:
        odds = endings.log_odds(texts, finals)
    if thresholds:
        table = F.create_map(*(F.lit(x) for (lang, column), v in thresholds.items() for x in (f"{lang}\x1f{column}", float(v))))
        limit = F.coalesce(F.try_element_at(table, F.concat_ws("\x1f", "lang", "column")), limit)
    rows = judged.join(odds, "class", "left")
    by_model = (F.col("verdict") == "open") & (F.coalesce("log_odds", F.lit(0.0)) < limit)
    return rows.select("id", "column", "lang", F.when(F.col("verdict") == "open", F.col("log_odds")).alias("log_odds"), ((F.col("verdict") == "cut") | by_model).alias("cut"))


def rates(df: DataFrame, **options) -> DataFrame:
    """(column, n_texts, n_cut, share) per source, from the same table as ``truncated``."""
    t = truncated(df, **options)
    return t.groupBy("column").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share"))
