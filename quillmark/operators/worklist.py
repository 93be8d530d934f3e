"""Rubrics of many cases refined by a first-in first-out worklist, each case by itself; and weights from their votes."""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.pairs import PASS


_LABEL = re.compile(r"^(?:new )?rubric\s*\d+\s*[:.\-]?\s*", re.I)


def _bare(text: str) -> str:
    """A rubric's line without its label or bullet, as ``text.without_label`` has it."""
    line = _LABEL.sub("", " ".join(text.split()))
    return " ".join(re.sub(r"^\s*[-*•]\s*", "", line).split())


def halves(text: str) -> list[str]:
    """An offline decomposition: a rubric's parts around its first comma, semicolon or 'and', if both have two words or more."""
    parts = [_bare(p) for p in re.split(r"[,;]\s+|\s+and\s+", text, maxsplit=1)]
    return parts if len(parts) == 2 and all(" " in p for p in parts) else []


def _tokens(text: str) -> frozenset[str]:
    """``text.tokens`` of one text."""
    return frozenset(w for w in re.findall("[a-z0-9_]+", text.lower()) if len(w) > 1 and w not in T.STOPWORDS)


class Case:
    """The worklist of one case: what was seen and what was accepted. ``answers``: tokens, strength and number of the responses."""

    def __init__(self, answers: list[tuple[frozenset[str], bool | None, int]], many: int, depth: int, rejects: int):
        self.answers, self.many, self.depth, self.rejects = answers, many, depth, rejects
        self.seen: set[str] = set()
        self.held: set[frozenset[str]] = set()
        self.accepted: list[tuple[str, int, int]] = []

    def run(self, texts: list[str]) -> list[tuple[str, int, int]]:
        queue, rejected = deque((t, 0) for t in texts), 0
        while queue and rejected < self.rejects:
            text, level = queue.popleft()
            more = self.take(text, level)
            rejected += more is None
            queue.extend((p, level + 1) for p in more or ())
        return self.accepted

    def take(self, text: str, level: int) -> list[str] | None:
        """What a rubric leads to: its parts for the back of the queue, none if it is accepted, None if it is rejected."""
        key = _bare(text).lower()
        if not key or key in self.seen:
            return None
        self.seen.add(key)
        own = _tokens(text)
        met = [(strong, n) for words, strong, n in self.answers if own and len(own & words) >= PASS * len(own)]
        yes = sum(n for _, n in met)
        if not yes:
            return None
        if yes > self.many and level < self.depth:
            return halves(text) or None
        strengths = {s for s, _ in met}
        if (False in strengths and True not in strengths) or own in self.held:
            return None
        self.held.add(own)
        self.accepted.append((text, level, yes))
        return []


def _refine(many: int, depth: int, rejects: int):
    def step(key: tuple, rubrics: pd.DataFrame, responses: pd.DataFrame) -> pd.DataFrame:
        answers = [(frozenset(t), None if s is None or pd.isna(s) else bool(s), n) for t, s, n in zip(responses["t"], responses["strong"], responses["n"], strict=True)]
        got = Case(answers, many, depth, rejects).run(rubrics.sort_values(["pos", "text"])["text"].tolist())
        return pd.DataFrame([(key[0], at, *g) for at, g in enumerate(got)], columns=["case_id", "ord", "text", "depth", "yes"])

    return step


def refine(rubrics: DataFrame, responses: DataFrame, many: int = 2, depth: int = 3, rejects: int = 15) -> DataFrame:
    """(case_id, ord, text, depth, yes) of the accepted rubrics of each case, in the order of acceptance.

    ``rubrics`` has case_id, pos, text; ``responses`` has case_id, text, strong BOOLEAN (null for neither). The head of a case's
    queue is taken: blank or seen before, rejected; no response satisfies it, rejected; more than ``many`` do and it is not
    ``depth`` deep, its halves go to the back of the queue, or it is rejected if it has none; the weak reference satisfies it
    and the strong one doesn't, rejected; its tokens are those of an accepted one, rejected; else it is accepted. A case stops
    at ``rejects`` rejections or an empty queue.

    Cases are independent: one shuffle brings each together. Repeats travel as far as they can matter: of equal responses one
    with its number, of equal rubrics no more than could be rejected before the case stops.
    """
    w = W.partitionBy("case_id", "text").orderBy("pos")
    few = rubrics.where("text is not null").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rejects + 1).select("case_id", "pos", "text")
    answers = responses.groupBy("case_id", F.array_sort(T.tokens("text")).alias("t"), "strong").agg(F.count("*").alias("n"))
    return few.groupBy("case_id").cogroup(answers.groupBy("case_id")).applyInPandas(_refine(many, depth, rejects), "case_id string, ord long, text string, depth int, yes long")


def vote_rates(votes: DataFrame) -> DataFrame:
    """(rubric_id, yes_count, n, vote_rate, group_rates) of votes(rubric_id, grp, yes BOOLEAN); group_rates is a map."""
    by_group = votes.groupBy("rubric_id", "grp").agg(F.count_if("yes").alias("y"), F.count("*").alias("n"))
    return by_group.groupBy("rubric_id").agg(
        F.sum("y").alias("yes_count"), F.sum("n").alias("n"), (F.sum("y") / F.sum("n")).alias("vote_rate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", (F.col("y") / F.col("n")).alias("rate"))))).alias("group_rates"),
    )


def _whiten(ridge: float):
    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["i"]))
        at = {k: n for n, k in enumerate(names)}
        sigma = np.zeros((len(names), len(names)))
        for i, j, c in zip(pdf["i"], pdf["j"], pdf["cov"], strict=True):
            sigma[at[i], at[j]] = sigma[at[j], at[i]] = c if c is not None and np.isfinite(c) else 0.0
        values, vectors = np.linalg.eigh(sigma + ridge * np.eye(len(names)))
        w = np.clip(vectors @ ((vectors.T @ np.ones(len(names))) / np.sqrt(np.maximum(values, 1e-12))), 0.0, None)
        if pdf["samples"].max() < 2 or not np.isfinite(w).all() or w.sum() <= 0:
            w = np.ones(len(names))
        w = w * len(names) / w.sum()
        return pd.DataFrame({"case_id": key[0], "rubric": names, "weight": w})

    return step


def whitened_weights(votes: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """(case_id, rubric, weight) from votes(case_id, sample, rubric, vote DOUBLE): the covariance's inverse root times ones.

    Covariances are Spark aggregates over all samples, so a case of any number of samples is one small matrix; negative
    weights are cut to 0 and the rest scaled to sum to the number of rubrics. A single sample, or no positive weight, gives
    ones. A missing vote leaves its sample out of the pairs of that rubric.
    """
    a = votes.select("case_id", "sample", F.col("rubric").alias("i"), F.col("vote").cast("double").alias("x"))
    b = votes.select("case_id", "sample", F.col("rubric").alias("j"), F.col("vote").cast("double").alias("y"))
    cov = a.join(b, ["case_id", "sample"]).where("i <= j").groupBy("case_id", "i", "j").agg(F.covar_samp("x", "y").alias("cov"), F.count("*").alias("samples"))
    return cov.groupBy("case_id").applyInPandas(_whiten(ridge), "case_id string, rubric string, weight double")
