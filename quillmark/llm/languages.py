"""Languages of texts: by script and frequent words, and by profiles of character n-grams that are fitted to the table's prompts.

A profile is the set of the most frequent runs of three characters in the prompts of one language, counted over all of
them. How much of a text its runs cover tells whether the text is in that language, whatever other language it may be in.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions.words import plain

#: Characters of a run, and runs of a profile.
RUN, KEPT = 3, 3000
#: Prompts that a language needs for a profile.
LEAST_TEXTS = 20
#: The share of a language's prompts that its profile may cover less than its floor.
BELOW = 0.002
#: Letters that a text needs to be told by a profile, and the share of frequent words from which it isn't asked.
LEAST_LETTERS, FREQUENT = 45, 0.15

_CJK = re.compile(r"[㐀-䶿一-鿿]")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
# Frequent words of the languages in Latin script.
_STOPWORDS = {
    "en": "the of and to is in that it for as with on so not from which what how this are be by or an at was were has have had you your they their them than then if when where while would could should can will who why there here just only also its into over about between because although unless before after each every first second any some no yes more most other such same",
    "de": "der die das und ist nicht mit für von dem den des wie man zu auf noch wenn ein eine einen einem einer es im am zum zur sich auch als aber oder nur kann muss soll sollte wird wurde werden hat haben sind war waren dort dann denn doch weil ohne über unter nach bei aus an sie er ich wir ihr dass damit obwohl sobald beide alles alle was wer warum bitte zuerst danach",
    "fr": "le la les des est pour une un dans du de et que qui pas il elle ils elles on nous vous je tu a au aux avec sans sur sous par plus ne ce cette ces son sa ses leur mais ou où donc car si comme tout tous toute fait être avoir peut doit faut même encore aussi après avant quand dont sont était ont y en se lui entre chaque cela",
    "es": "el la los las de que en y para con no se por una un lo del al es son fue era ha han hay como más pero sus su le les ya o este esta estos estas eso todo todos cuando donde porque sin sobre entre también después antes aunque si muy puede debe tiene hacer cada desde hasta quien cuál qué cómo por quién mismo misma primero luego pues al",
}
_PROFILES: dict[str, list[str]] = {}
for _language, _list in _STOPWORDS.items():
    for _word in dict.fromkeys(_list.split()):
        _PROFILES.setdefault(_word, []).append(_language)
_LATIN_WORD = re.compile(r"[^\W\d_]+")
_MARKS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ó": "es", "í": "es", "ú": "es", "è": "fr", "ê": "fr", "ç": "fr", "œ": "fr", "à": "fr", "ù": "fr", "â": "fr", "î": "fr", "û": "fr"}
_SCRIPTS = [(re.compile(p), n) for p, n in ((r"[぀-ヿ]", "ja"), (r"[가-힯]", "ko"), (r"[Ѐ-ӿ]", "ru"), (r"[؀-ۿ]", "ar"), (r"[֐-׿]", "he"), (r"[ऀ-ॿ]", "hi"), (r"[Ͱ-Ͽ]", "el"), (r"[฀-๿]", "th"))]


def _words(text: str) -> tuple[str, list[str]]:
    """The text without code, made plain, and its runs of letters."""
    low = plain(_CODE.sub(" ", text) if "`" in text or "~" in text else text)
    return low, _LATIN_WORD.findall(low)


def language(text: str, least: float = 2.0) -> str | None:
    """The language of a text by script, frequent words and letters, or None if nothing tells it."""
    return _told(*_words(text), least)


def _told(low: str, found: list[str], least: float = 2.0) -> str | None:
    letters = sum(map(len, found))
    if not letters:
        return None
    ascii_only = low.isascii()
    if not ascii_only:
        for pattern, name in _SCRIPTS:
            if len(pattern.findall(low)) > 0.2 * letters:
                return name
        # A character of Chinese carries about what three Latin letters do.
        if 3 * (n := len(_CJK.findall(low))) > letters - n:
            return "zh"
    count: dict[str, float] = defaultdict(float)
    for w in found:
        for k in _PROFILES.get(w, ()):
            count[k] += 1
    if not ascii_only:
        for c, k in _MARKS.items():
            if n := low.count(c):
                count[k] += 0.5 * n
    if not count:
        return None
    (best, n), *others = sorted(count.items(), key=lambda x: -x[1])[:2]
    if n < least or (others and n - others[0][1] < max(1.0, 0.2 * n)):
        return None
    return best


def runs(found: list[str]) -> list[str]:
    """The runs of characters of a text's words, each word with a blank on both sides."""
    t = f" {' '.join(found)} "
    return [t[i : i + RUN] for i in range(len(t) - RUN + 1)]


def covered(found: list[str], profile: frozenset[str]) -> float:
    each = runs(found)
    return sum(map(profile.__contains__, each)) / len(each)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tally: dict[str, Counter] = defaultdict(Counter)
    texts: Counter[str] = Counter()
    for b in batches:
        for t in b["text"]:
            low, found = _words(t)
            if (k := _told(low, found)) in _STOPWORDS:
                tally[k].update(runs(found))
                texts[k] += 1
        if sum(map(len, tally.values())) > 500_000:  # what a task holds
            yield pd.DataFrame([(k, r, n, 0) for k, c in tally.items() for r, n in c.items()], columns=["lang", "run", "n", "texts"])
            tally.clear()
    yield pd.DataFrame([(k, r, n, 0) for k, c in tally.items() for r, n in c.items()] + [(k, "", 0, n) for k, n in texts.items()], columns=["lang", "run", "n", "texts"])


def _cover(profiles: dict[str, frozenset[str]]):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                low, found = _words(t)
                if (k := _told(low, found)) in profiles:
                    out.append((k, round(covered(found, profiles[k]), 3)))
            yield pd.DataFrame(out, columns=["lang", "share"]).astype({"share": "float64"})

    return step


def fitted(texts: DataFrame) -> dict[str, tuple[frozenset[str], float]]:
    """The profile of each language of texts(text STRING) that the frequent words tell, and the least share it covers of such a text but for BELOW of them.

    Counted over all texts; KEPT runs and one number for each of a few languages come to the driver.
    """
    some = texts.where("text is not null").select("text")
    counts = some.mapInPandas(_count, "lang string, run string, n long, texts long").groupBy("lang", "run").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).persist(StorageLevel.MEMORY_AND_DISK)
    enough = counts.groupBy("lang").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= LEAST_TEXTS).select("lang")
    ranked = counts.where("run <> ''").join(enough, "lang", "left_semi").withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "run"))).where(F.col("at") <= KEPT)
    held: dict[str, set[str]] = defaultdict(set)
    for r in ranked.select("lang", "run").collect():
        held[r["lang"]].add(r["run"])
    profiles = {k: frozenset(v) for k, v in held.items()}
    counts.unpersist()
    if not profiles:
        return {}
    floors = some.mapInPandas(_cover(profiles), "lang string, share double").groupBy("lang").agg(F.percentile("share", F.lit(BELOW)).alias("floor")).collect()
    return {r["lang"]: (profiles[r["lang"]], r["floor"]) for r in floors}


def foreign(found: list[str], own: str, profiles: dict[str, tuple[frozenset[str], float]]) -> bool:
    """Whether words are in none of the ways that the texts of a language have: few frequent words of it, and few of its runs."""
    if own not in profiles or sum(map(len, found)) < LEAST_LETTERS:
        return False
    if sum(own in _PROFILES.get(w, ()) for w in found) >= FREQUENT * len(found):
        return False
    profile, floor = profiles[own]
    return covered(found, profile) < floor
