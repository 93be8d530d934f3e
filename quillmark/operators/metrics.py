"""Benchmark metrics as grouped aggregates: summaries, best of n, round robins, 3 x 3 matrices, weighted sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarize(decisions: DataFrame, *keys: str) -> DataFrame:
    """Counts, accuracy, tie rate and mean margin of decisions(side, gold_side, margin, tie, gold_margin, *keys).

    A row without a margin is skipped; all rates and the mean margin are over the usable rows, and null where none are.
    """
    usable = F.count("margin")
    right = F.count_if(F.col("margin").isNotNull() & (F.col("side") == F.col("gold_side")))
    over = lambda x: F.try_divide(x.cast("double"), usable)
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("total"), usable.alias("usable"), (F.count("*") - usable).alias("skipped"), right.alias("correct"), (usable - right).alias("incorrect"),
        over(right).alias("accuracy"), over(F.count_if("tie")).alias("tie_rate"), F.try_divide(F.sum("gold_margin"), usable).alias("avg_margin"),
    )


def best_of_n(scored: DataFrame, *keys: str) -> DataFrame:
    """One row for each item: whether its chosen response beats all rejected ones, pairs won, least and greatest margin.

    ``scored`` has the keys, chosen DOUBLE and rejected ARRAY<DOUBLE>; an item without rejected responses is dropped.
    """
    pairs = scored.select(*keys, "chosen", F.explode("rejected").alias("other")).select(*keys, (F.col("chosen") - F.col("other")).alias("margin"))
    return pairs.groupBy(*keys).agg(F.bool_and(F.col("margin") > 0).alias("correct"), F.count("*").alias("pairs"), F.count_if(F.col("margin") > 0).alias("pairs_won"), F.min("margin").alias("min_margin"), F.max("margin").alias("max_margin"))


def round_robin(scored: DataFrame, key: str) -> DataFrame:
    """(key, pos, score): each response of an item against every other; the mean of its margins, antisymmetric in each pair.

    ``scored`` has key, pos and value. The sum over the others of (own - other) needs only the item's sum and count, so no
    pairs are made. Items with one response score 0.
    """
    scored = scored.select(key, "pos", "value")
    of = scored.groupBy(key).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    one = F.when(F.col("n") > 1, (F.col("n") * F.col("value") - F.col("total")) / (F.col("n") - 1)).otherwise(0.0)
    return scored.join(of, key).select(key, "pos", one.alias("score"))


def ties_stats(correct: Column, incorrect: Column) -> list[Column]:
    """accurate, spread among the correct (null for one), and separation from the incorrect, of two arrays of scores."""
    low, high, worst = F.array_min(correct), F.array_max(correct), F.array_max(incorrect)
    return [(low > worst).alias("accurate"), F.when(F.size(correct) > 1, high - low).alias("spread"), (low - worst).alias("separation")]


def ties_from(low: Column, high: Column, worst: Column, n: Column) -> list[Column]:
    """The same from aggregates: the least and greatest of ``n`` correct scores and the greatest incorrect one."""
    return [(low > worst).alias("accurate"), F.when(n > 1, high - low).alias("spread"), (low - worst).alias("separation")]


def ties_score(groups: DataFrame) -> DataFrame:
    """The published blend over groups(ref_accurate, tied_accurate, tied_separation, ref_separation, spread); nulls count as 0."""
    near = F.least("ref_separation", "tied_separation")
    part = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    # The weights, which sum to 1.01.
    score = 0.30 * part(yes(F.col("tied_accurate"))) + 0.30 * part(yes(F.col("ref_accurate"))) + 0.20 * part(yes(F.col("tied_separation") > F.col("spread"))) + 0.20 * part(yes(near > F.col("spread"))) + 0.01 * part(near - F.col("spread"))
    return groups.agg(F.count("*").alias("n_groups"), score.alias("score"))


def matrix(cells: DataFrame, *keys: str) -> DataFrame:
    """Mean accuracy by difficulty of 3 x 3 cells(row, col, win DOUBLE, *keys): hard above, normal on, easy below the diagonal."""
    at = lambda c: F.avg(F.when(c, F.col("win")))
    return cells.groupBy(*keys).agg(at(F.col("row") > F.col("col")).alias("easy"), at(F.col("row") == F.col("col")).alias("normal"), at(F.col("row") < F.col("col")).alias("hard"), F.avg("win").alias("all"), F.count("*").alias("n_cells"))


def section_scores(by_subset: DataFrame, weights: DataFrame, subset: str, section: str) -> DataFrame:
    """Accuracy by section: means of the subsets' accuracies weighted by the fixed counts in weights(subset, section, weight).

    Subsets without a weight count for nothing; sections without a subset give no row. The dimension is joined, not sent whole.
    """
    joined = by_subset.join(weights, subset)
    return joined.groupBy(section).agg((F.sum(F.col("weight") * F.col("accuracy")) / F.sum("weight")).alias("score"), F.count("*").alias("n_subsets"))


def strict(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_items, strict_accuracy, pair_total, pair_correct): items of cells(item, win DOUBLE, *keys) all of whose cells are won."""
    items = cells.groupBy(*keys, "item").agg(F.bool_and(F.col("win") > 0.5).alias("all_won"), F.count("*").alias("n"), F.sum("win").alias("won"))
    return items.groupBy(*keys).agg(F.count("*").alias("n_items"), F.avg(F.col("all_won").cast("int")).alias("strict_accuracy"), F.sum("n").alias("pair_total"), F.sum("won").alias("pair_correct"))


# The domains whose equal-weight mean is the score.
COVERED = ("Chat", "Code", "Math", "Safety")


def macro(by_domain: DataFrame) -> DataFrame:
    """One row (score, easy, normal, hard, n_domains): means over those of COVERED that by_domain(domain, easy, normal, hard, all) has; nulls without any."""
    some = by_domain.where(F.col("domain").isin(*COVERED))
    return some.agg(F.avg("all").alias("score"), *(F.avg(c).alias(c) for c in ("easy", "normal", "hard")), F.count("*").alias("n_domains"))


def mean_of_subsets(accuracies: DataFrame, ties: DataFrame) -> DataFrame:
    """One row (score, n_subsets): the mean over accuracies(subset, accuracy) and, for the subset of ties, ties(subset, score)."""
    each = accuracies.select("subset", F.col("accuracy").alias("x")).unionByName(ties.select("subset", F.col("score").alias("x")))
    return each.agg(F.avg(F.coalesce("x", F.lit(0.0))).alias("score"), F.count("*").alias("n_subsets"))
