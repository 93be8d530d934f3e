"""Comparisons put right and decisions recovered from a part of them; results in terms of the chosen and the rejected response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.pairs import TIE


def settled(better: Column, pass_a: Column, pass_b: Column, hint: Column) -> Column:
    """The better side: as named (A or B in any case), else the one that alone passes, else the hint; null if nothing tells."""
    side = lambda c: F.when(F.upper(F.trim(c)).isin("A", "B"), F.upper(F.trim(c)))
    return F.coalesce(side(better), F.when(pass_a & ~pass_b, "A").when(pass_b & ~pass_a, "B"), side(hint))


def covered(selected: Column, compared: Column, expected: Column) -> Column:
    """Whether as many rubrics were selected, and as many compared, as are expected; false for nulls."""
    return F.coalesce((selected == expected) & (compared == expected), F.lit(False))


def recovered(singles: DataFrame, direct: DataFrame, tie: float = TIE) -> DataFrame:
    """(record_idx, n_recovered, margin, side, source): one decision from predictions(record_idx, margin) made rubric by rubric.

    A null margin is a rubric that gave none. Margins are summed; between -tie and tie the side is ``tie``. The source says
    whether all rubrics were recovered or some; a pair without any takes the side of direct(record_idx, direct).
    """
    sums = singles.groupBy("record_idx").agg(F.count("margin").alias("n_recovered"), F.count("*").alias("n"), F.sum("margin").alias("margin"))
    one = sums.join(direct, "record_idx", "left")
    side = F.when(F.col("n_recovered") == 0, F.col("direct")).when(F.col("margin") > tie, "A").when(F.col("margin") < -tie, "B").otherwise("tie")
    source = F.when(F.col("n_recovered") == 0, "direct").when(F.col("n_recovered") < F.col("n"), "partial").otherwise("recovered")
    return one.select("record_idx", "n_recovered", "margin", side.alias("side"), source.alias("source"))


def sane(selected: DataFrame, *keys: str) -> DataFrame:
    """Selected rubrics(keys, bank_id, pos, text, bank_text) that can be judged: a malformed text gives way to the bank's, one row for each bank_id.

    Rows whose texts are both malformed are dropped before the first by ``pos`` is kept; a null bank_id counts as one id.
    """
    text = F.when(~T.still_malformed("text"), F.trim("text")).when(~T.still_malformed("bank_text"), F.trim("bank_text"))
    first = F.row_number().over(W.partitionBy(*keys, "bank_id").orderBy("pos"))
    return selected.withColumn("text", text).where("text is not null").withColumn("_rn", first).where("_rn = 1").drop("_rn")


def rewritten(rubrics: DataFrame, replies: DataFrame) -> DataFrame:
    """rubrics(bank_id, text) with the last reply(bank_id, pos, text) of each where it holds text, and the old one as bank_text."""
    last = replies.where("bank_id is not null").groupBy("bank_id").agg(F.max_by("text", "pos").alias("new_text"))
    good = F.trim("new_text") != ""
    return rubrics.join(last, "bank_id", "left").withColumns({"bank_text": F.when(good, F.col("text")), "text": F.coalesce(F.when(good, F.trim("new_text")), "text")}).drop("new_text")


def position(side: Column, gold_side: Column) -> Column:
    """``chosen`` or ``rejected`` for side A or B; null for a tie or none."""
    return F.when(side.isin("A", "B"), F.when(side == gold_side, "chosen").otherwise("rejected"))


def labelled(compared: DataFrame) -> DataFrame:
    """compared(score_a, score_b, delta, better, gold_side, ...) with scores, delta and better side in terms of the chosen response."""
    turned = F.col("gold_side") == "B"
    return compared.withColumns({
        "score_chosen": F.when(turned, F.col("score_b")).otherwise(F.col("score_a")), "score_rejected": F.when(turned, F.col("score_a")).otherwise(F.col("score_b")),
        "delta_vs_chosen": F.when(turned, 0.0 - F.col("delta")).otherwise(F.col("delta")), "better_position": position(F.col("better"), F.col("gold_side")),
    }).drop("score_a", "score_b", "delta", "better")


def details(own: DataFrame, reference: DataFrame, *parts: str) -> DataFrame:
    """One row for each record of ``own`` with its ``parts`` and those of ``reference`` as structs; null where it has no such record."""
    as_struct = lambda df, name: df.select("record_idx", F.struct(*parts).alias(name))
    return as_struct(own, "own").join(as_struct(reference, "reference"), "record_idx", "left")


def expand(cache: DataFrame, support: DataFrame, examples: DataFrame, hard: DataFrame, mine) -> DataFrame:
    """Candidates (example_id, text, signature) that the support pairs add to cache(example_id, text), one for each new signature.

    ``mine(pairs)`` makes (example_id, text) of pairs(example_id, positive, negative): those of the support(record_idx) with
    their own responses in examples(record_idx, example_id, positive, negative), and with hard(record_idx, negative) where there is one. Rows of the cache win;
    of equal new ones the smallest text stays.
    """
    own = examples.join(support.select("record_idx"), "record_idx", "left_semi")
    against = own.drop("negative").join(hard.select("record_idx", "negative"), "record_idx").where("negative is not null")
    pairs = own.select("example_id", "positive", "negative").unionByName(against.select("example_id", "positive", "negative"))
    fresh = mine(pairs).withColumn("signature", T.signature("text")).where("signature <> ''").groupBy("example_id", "signature").agg(F.min("text").alias("text"))
    return fresh.join(cache.select("example_id", T.signature("text").alias("signature")).distinct(), ["example_id", "signature"], "left_anti").select("example_id", "text", "signature")


def excluded(before: DataFrame, removed: DataFrame) -> DataFrame:
    """The signatures that candidates must not have again: those of ``before``(signature) and of the texts of ``removed``."""
    return before.select("signature").unionByName(removed.select(T.signature("text").alias("signature"))).where("signature <> ''").distinct()
