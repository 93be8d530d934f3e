"""Pairwise comparison of responses by rubrics: orientation, an offline judge, margins and decisions.

A judge is a function from a DataFrame of comparisons (with token arrays) to one with pass_a, pass_b and better. The one
here is offline and deterministic: a rubric passes for a response that holds enough of its tokens. A served model is
plugged in as ``mapInPandas`` over the same rows (see ``stages.judge_missing``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T

#: Share of a rubric's tokens that a response must hold to pass.
PASS = 0.2
#: Margins of no more than this decide nothing.
TIE = 0.05


def oriented(prefs: DataFrame) -> DataFrame:
    """(record_idx, example_id, prompt_text, language, domain, response_a, response_b, gold_side) of the pairs with two responses.

    Pairs with a null or blank response are dropped. A and B are placed by the hash of the pair, so a rerun places them alike.
    """
    both = prefs.where("trim(chosen_response) <> '' and trim(rejected_response) <> ''")
    swap = T.positive_in_b("example_id", "chosen_response", "rejected_response")
    return both.withColumn("swap", swap).select(
        "record_idx", "example_id", "prompt_text", "language", "domain",
        F.when(F.col("swap"), F.col("rejected_response")).otherwise(F.col("chosen_response")).alias("response_a"),
        F.when(F.col("swap"), F.col("chosen_response")).otherwise(F.col("rejected_response")).alias("response_b"),
        F.when(F.col("swap"), "B").otherwise("A").alias("gold_side"),
    )


def share_of(rubric: Column | str, response: Column | str) -> Column:
    """Share of a rubric's tokens in a response's tokens; 0 for a rubric without tokens."""
    rubric, response = T.col(rubric), T.col(response)
    return F.when(F.size(rubric) == 0, 0.0).otherwise(F.size(F.array_intersect(rubric, response)) / F.size(rubric))


def comparisons(pairs: DataFrame, rubrics: DataFrame) -> DataFrame:
    """One row for each rubric of each pair: verdicts of both sides, the better one, its delta and weight.

    ``pairs`` is ``oriented``; ``rubrics`` has rubric_id, example_id, pos, text, facet and importance. Tokens are made once
    for each pair and once for each rubric, before the join on example_id.
    """
    sides = pairs.select("record_idx", "example_id", T.tokens("response_a").alias("t_a"), T.tokens("response_b").alias("t_b"))
    asked = rubrics.select("rubric_id", "example_id", "pos", T.facet("facet").alias("facet"), T.importance("importance").alias("importance"), T.tokens("text").alias("t_r"))
    each = sides.join(asked, "example_id").withColumns({"score_a": share_of("t_r", "t_a"), "score_b": share_of("t_r", "t_b")}).drop("t_a", "t_b", "t_r")
    judged = each.withColumns({"pass_a": F.col("score_a") >= PASS, "pass_b": F.col("score_b") >= PASS, "better": F.when(F.col("score_a") > F.col("score_b"), "A").when(F.col("score_b") > F.col("score_a"), "B")})
    return judged.withColumns({"delta": T.delta(F.col("pass_a"), F.col("pass_b"), F.col("better")), "weight": T.importance_weight("importance")})


def margins(compared: DataFrame) -> DataFrame:
    """(record_idx, n_rubrics, margin, vote): rubrics of some weight, weighted mean of the deltas, and the sum of their signs."""
    return compared.groupBy("record_idx").agg(
        F.count_if(F.col("weight") > 1e-9).alias("n_rubrics"), (F.sum(F.col("weight") * F.col("delta")) / F.sum("weight")).alias("margin"), F.sum(F.signum("delta")).cast("long").alias("vote")
    )


def decide(pairs: DataFrame, by_margin: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One decision a pair: by its margin if that is large enough, else by the sign of its hint, else directly by the overlap with the prompt, else A.

    hints(record_idx, hint) has the sums of what a judge said of the pair as a whole in each chunk of rubrics: the chunk's
    weight, negative for B; a pair without one, or with 0, has no hint.
    """
    t = T.tokens("prompt_text")
    direct_a, direct_b = share_of(t, T.tokens("response_a")), share_of(t, T.tokens("response_b"))
    direct = pairs.select("record_idx", "language", "domain", "gold_side", F.when(direct_b > direct_a, "B").otherwise("A").alias("direct"))
    m = direct.join(by_margin, "record_idx", "left")
    m = m.withColumn("hint", F.lit(0.0)) if hints is None else m.join(hints.select("record_idx", "hint"), "record_idx", "left").withColumn("hint", F.coalesce("hint", F.lit(0.0)))
    clear = F.coalesce(F.abs("margin") > TIE, F.lit(False))
    hinted = F.col("hint") != 0
    return m.select(
        "record_idx", "language", "domain", "gold_side", F.coalesce("n_rubrics", F.lit(0).cast("long")).alias("n_rubrics"), "margin", F.coalesce("vote", F.lit(0).cast("long")).alias("vote"), "direct",
        F.when(clear & (F.col("margin") > 0), "A").when(clear, "B").when(hinted, F.when(F.col("hint") > 0, "A").otherwise("B")).otherwise(F.col("direct")).alias("side"),
        F.when(clear, "margin").when(hinted, "hint").otherwise("direct").alias("source"),
    ).withColumn("correct", F.col("side") == F.col("gold_side")).withColumn("gold_margin", F.when(F.col("gold_side") == "B", 0.0 - F.col("margin")).otherwise(F.col("margin")))


def low_evidence(decisions: DataFrame, most: int = 2) -> DataFrame:
    """Decisions of pairs with one to ``most`` rubrics made by plain votes; an even vote goes to the direct judge."""
    few = (F.col("n_rubrics") > 0) & (F.col("n_rubrics") <= most)
    side = F.when(~few, F.col("side")).when(F.col("vote") > 0, "A").when(F.col("vote") < 0, "B").otherwise(F.col("direct"))
    source = F.when(~few, F.col("source")).when(F.col("vote") != 0, "vote").otherwise("direct")
    return decisions.withColumns({"side": side, "source": source}).withColumn("correct", F.col("side") == F.col("gold_side"))


def facet_votes(compared: DataFrame, cap: int = 2) -> DataFrame:
    """(record_idx, capped_vote, vote): signs summed over the first ``cap`` rubrics of each facet, and over all."""
    from pyspark.sql import Window as W

    w = W.partitionBy("record_idx", "facet").orderBy("pos", "rubric_id")
    sign = F.signum("delta")
    ranked = compared.withColumn("rn", F.row_number().over(w))
    return ranked.groupBy("record_idx").agg(F.sum(F.when(F.col("rn") <= cap, sign).otherwise(0)).cast("long").alias("capped_vote"), F.sum(sign).cast("long").alias("vote"))


def guarded(decisions: DataFrame, votes: DataFrame) -> DataFrame:
    """Decisions turned round where the capped and the plain vote agree with each other and not with the decision."""
    v = decisions.drop("vote").join(votes, "record_idx", "left")
    against = (F.signum("capped_vote") == F.signum("vote")) & (F.col("vote") != 0) & (F.when(F.col("vote") > 0, "A").otherwise("B") != F.col("side"))
    side = F.when(against, F.when(F.col("side") == "A", "B").otherwise("A")).otherwise(F.col("side"))
    return v.withColumns({"flipped": F.coalesce(against, F.lit(False)), "side": side}).withColumn("correct", F.col("side") == F.col("gold_side"))


def escalated(compared: DataFrame, start: int = 3, most: int | None = None) -> DataFrame:
    """(record_idx, k, margin, side): each pair decided by the fewest of its heaviest rubrics, ``start`` or more, that decide.

    The margins over the first k rubrics are running sums in one window, so no pair is judged again for a larger k. Pairs
    that no k up to ``most`` (all rubrics if None) decides have their last k and a null side; a pair of fewer rubrics than ``start`` is tried once.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("record_idx").orderBy(F.desc("weight"), "rubric_id")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    n = F.count("*").over(W.partitionBy("record_idx"))
    steps = compared.select("record_idx", F.row_number().over(order).alias("k"), (F.sum(F.col("weight") * F.col("delta")).over(so_far) / F.sum("weight").over(so_far)).alias("margin"), n.alias("n"))
    tried = steps.where((F.lit(True) if most is None else F.col("k") <= most) & ((F.col("k") >= start) | (F.col("k") == F.col("n"))))
    clear = F.abs("margin") > TIE
    best = F.min_by(F.struct("k", "margin"), F.when(clear, F.col("k")))
    last = F.max_by(F.struct("k", "margin"), "k")
    got = tried.groupBy("record_idx").agg(F.coalesce(best, last).alias("s")).select("record_idx", "s.k", "s.margin")
    return got.withColumn("side", F.when(F.col("margin") > TIE, "A").when(F.col("margin") < -TIE, "B"))
