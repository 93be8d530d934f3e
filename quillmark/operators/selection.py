"""Selection: sparsemax, top-k, TF-IDF, diverse subsets, support pairs, a seeded split, and a trained selector."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as D

from quillmark.functions import text as T
from quillmark.session import durable, sized


def sparsemax(logits: DataFrame, key: str, pos: str, z: str) -> DataFrame:
    """(key, pos, alpha) of the projection of each key's logits onto the simplex; alpha is 0 outside its support.

    One shuffle by key: sort, running sum, support and threshold are windows over the same partitioning. Null logits are
    dropped.
    """
    rows = logits.where(F.col(z).isNotNull()).select(F.col(key).alias("_key"), F.col(pos).alias("_pos"), F.col(z).alias("_z"))
    by, every = W.partitionBy("_key").orderBy(F.desc("_z"), "_pos"), W.partitionBy("_key")
    rows = rows.withColumns({"_k": F.row_number().over(by), "_c": F.sum("_z").over(by.rowsBetween(W.unboundedPreceding, 0)) - 1.0})
    rows = rows.withColumn("_n", F.max(F.when(F.col("_z") * F.col("_k") > F.col("_c"), F.col("_k"))).over(every))
    rows = rows.withColumn("_tau", F.max(F.when(F.col("_k") == F.col("_n"), F.col("_c") / F.col("_k"))).over(every))
    return rows.select(F.col("_key").alias(key), F.col("_pos").alias(pos), F.greatest(F.col("_z") - F.col("_tau"), F.lit(0.0)).alias("alpha"))


def top(df: DataFrame, key: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k rows of each key with the greatest score, the smaller ``tie`` first among equals; ``rn`` is their place."""
    w = W.partitionBy(key).orderBy(score.desc(), F.col(tie))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


@F.pandas_udf(D.StringType())
def without_accents(s: pd.Series) -> pd.Series:
    """Lower case, compatibility forms made plain, and combining marks dropped."""
    return s.map(lambda t: t.lower() if t.isascii() else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not unicodedata.combining(c)), na_action="ignore")


def terms(df: DataFrame) -> DataFrame:
    """(id, term, tf) of df(id, text): words of two letters, digits or underscores and more, without accents, and pairs of adjacent ones.

    All rows of an id are in one partition.
    """
    w = F.regexp_extract_all(without_accents("text"), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    two = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    each = df.where("text is not null").select("id", w.alias("w")).select("id", F.explode(F.concat("w", two)).alias("term")).where("term is not null")
    return each.repartition("id").groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, features: int = 4096) -> DataFrame:
    """(id, term, weight): L2-normalised tf * (ln((1 + n) / (1 + df)) + 1) over the ``features`` most frequent terms.

    n counts the texts that are not null. Texts are read into terms once, in one shuffle by id; the vocabulary, of at most
    ``features`` rows, is sent to all tasks, and the norm is a window over the same partitions.
    """
    tf = terms(df).persist(StorageLevel.MEMORY_AND_DISK)
    n = df.where("text is not null").count()
    vocabulary = durable(tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(features))
    raw = tf.join(sized(vocabulary), "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return raw.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))).alias("weight"))


def _diverse(k: int, same_facet: int, near: float, penalty: float):
    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "rubric_id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(t) for t in pdf["tokens"]]
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            left = [i for i in range(len(pdf)) if i not in chosen]
            roomy = [i for i in left if sum(pdf["facet"][j] == pdf["facet"][i] for j in chosen) < same_facet]

            def worth(i: int) -> float:
                most = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] and sets[j] else 0.0 for j in chosen), default=0.0)
                return pdf["weight"][i] - penalty * most - (most >= near)

            chosen.append(max(roomy or left, key=lambda i: (worth(i), -i)))
        return pdf.loc[chosen, ["example_id", "rubric_id"]].assign(place=range(1, len(chosen) + 1))

    return pick


def diverse(pool: DataFrame, k: int = 6, size: int = 18, same_facet: int = 2, near: float = 0.92, penalty: float = 0.35) -> DataFrame:
    """Greedy choice of k rubrics for each example: weight less ``penalty`` times the greatest overlap with those chosen.

    ``pool`` has example_id, rubric_id, text, facet and weight. Only the ``size`` heaviest of an example take part, which is
    what bounds each group. Overlaps of ``near`` or more cost 1 besides; a facet has ``same_facet`` places while others wait.
    """
    heaviest = top(pool.withColumn("tokens", T.tokens("text")), "example_id", F.col("weight"), "rubric_id", size)
    return heaviest.select("example_id", "rubric_id", "facet", "weight", "tokens").groupBy("example_id").applyInPandas(_diverse(k, same_facet, near, penalty), "example_id string, rubric_id long, place int")


def seeded_split(df: DataFrame, key: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with ``is_dev``: exactly max(1, round(n * ratio)) rows, those of the smallest hashes of seed and key, are dev.

    The cut is found from counts of 65,536 hash buckets; only the bucket it falls in is ranked. Rounds half to even.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rows = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy("_b").agg(F.count("*").alias("n")).orderBy("_b").collect()
    total = sum(r["n"] for r in counts)
    want = min(total, max(1, round(total * ratio))) if total else 0
    cut, left = -1, want
    for r in counts:
        cut = r["_b"]
        if r["n"] >= left:
            break
        left -= r["n"]
    in_cut = rows.where(F.col("_b") == cut).withColumn("is_dev", F.row_number().over(W.partitionBy("_b").orderBy("_h", key)) <= left)
    rest = rows.where(F.col("_b") != cut).withColumn("is_dev", F.col("_b") < cut)
    return rest.unionByName(in_cut).drop("_h", "_b")


def support_pairs(decisions: DataFrame, threshold: float, most: int, least: int = 1) -> DataFrame:
    """The ``most`` hardest pairs: those decided wrongly or with a gold margin up to ``threshold``, smallest margin first.

    Where there is none, the ``least`` pairs of smallest margin.
    """
    hard = decisions.where((F.col("gold_margin") <= threshold) | ~F.col("correct"))
    if hard.isEmpty():
        hard, most = decisions, least
    return hard.orderBy(F.col("gold_margin").asc_nulls_first(), "record_idx").limit(most)


_MOMENTS = "gradient array<double>, loss double, n long, n_adv long"


class Selector:
    """Two layers from a prompt's features to logits over the bank, sparsemax weights alpha, and softplus weights of the bank's entries.

    A pair's margin is the sum of alpha * weight * z over the entries; ``z`` holds what each entry says for the positive response.
    """

    def __init__(self, inputs: int, hidden: int, bank: int, seed: int = 13):
        rng = np.random.default_rng(seed)
        self.shapes = [(inputs, hidden), (hidden,), (hidden, bank), (bank,), (bank,)]
        self.parts = [rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) for s in self.shapes]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for i, s in enumerate(self.shapes):
            n = int(np.prod(s))
            self.parts[i] = flat[at : at + n].reshape(s)
            at += n

    def weights(self) -> np.ndarray:
        return np.logaddexp(0.0, self.parts[4])

    def alpha(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, hidden activations), a row for each row of x."""
        w1, b1, w2, b2, _ = self.parts
        h = np.maximum(x @ w1 + b1, 0.0)
        return simplex(h @ w2 + b2), h

    def gradient(self, x: np.ndarray, z: np.ndarray, adv: np.ndarray, mask: np.ndarray, share: tuple[float, float], similar: np.ndarray | None) -> tuple[np.ndarray, float]:
        """The sum over the rows of the gradient and of the loss: share[0] * softplus(-margin) + share[1] * mask * softplus(-adv margin) + alpha D alpha."""
        w2 = self.parts[2]
        alpha, h = self.alpha(x)
        w = self.weights()
        margin, adv_margin = (alpha * w * z).sum(1), (alpha * w * adv).sum(1)
        loss = share[0] * np.logaddexp(0, -margin).sum() + share[1] * (mask * np.logaddexp(0, -adv_margin)).sum()
        pull = -share[0] * expit(-margin)[:, None] * z - share[1] * (mask * expit(-adv_margin))[:, None] * adv
        d_alpha = pull * w
        if similar is not None:
            near = alpha @ similar
            loss += (near * alpha).sum()
            d_alpha = d_alpha + 2 * near
        d_raw = (pull * alpha).sum(0) * expit(self.parts[4])
        on = alpha > 0
        d_logits = on * (d_alpha - (d_alpha * on).sum(1, keepdims=True) / on.sum(1, keepdims=True))
        d_h = (d_logits @ w2.T) * (h > 0)
        return np.concatenate([(x.T @ d_h).ravel(), d_h.sum(0), (h.T @ d_logits).ravel(), d_logits.sum(0), d_raw]), float(loss)


def expit(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def simplex(z: np.ndarray) -> np.ndarray:
    """Sparsemax of each row."""
    s = -np.sort(-z, axis=1)
    c = np.cumsum(s, axis=1) - 1.0
    k = np.arange(1, z.shape[1] + 1)
    n = (s * k > c).sum(1)
    return np.maximum(z - (c[np.arange(len(z)), n - 1] / n)[:, None], 0.0)


def _arrays(b: pd.DataFrame) -> list[np.ndarray]:
    return [np.stack(b[c].to_numpy()) for c in ("x", "z", "adv")] + [b["mask"].to_numpy(dtype=float)]


def _gradients(model: Selector, share: tuple[float, float], similar: np.ndarray | None):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, loss, n, n_adv = np.zeros(len(model.flat())), 0.0, 0, 0
        for b in batches:
            if len(b):
                g, v = model.gradient(*_arrays(b), share, similar)
                grad, loss, n, n_adv = grad + g, loss + v, n + len(b), n_adv + int(b["mask"].sum())
        yield pd.DataFrame({"gradient": [grad.tolist()], "loss": [loss], "n": [n], "n_adv": [n_adv]})

    return step


_SCORES = ("n", "right", "adv_n", "adv_right", "adv_margin", "with_targets", "recall", "active", "margin")


def _scores(model: Selector, k: int):
    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(_SCORES))
        for b in batches:
            if not len(b):
                continue
            x, z, adv, mask = _arrays(b)
            alpha, _ = model.alpha(x)
            score = alpha * model.weights()
            margin, adv_margin = (score * z).sum(1), (score * adv).sum(1)
            top = np.zeros_like(score, dtype=bool)
            np.put_along_axis(top, np.argsort(-score, axis=1, kind="stable")[:, :k], True, axis=1)
            target = z > TARGET
            some = target.any(1)
            recall = (top & target)[some].sum(1) / target[some].sum(1)
            total += [len(b), (margin > 0).sum(), mask.sum(), (mask * (adv_margin > 0)).sum(), (mask * adv_margin).sum(), some.sum(), recall.sum(), (alpha > 0).mean(1).sum(), margin.sum()]
        yield pd.DataFrame([total], columns=list(_SCORES))

    return step


#: What an entry must say for the positive response to be a target.
TARGET = 0.05


def evaluate(model: Selector, rows: DataFrame, k: int = 6) -> dict[str, float]:
    """Accuracy, accuracy and margin against hard negatives, recall of the targets among the k best, activation rate, mean margin and weight.

    ``rows`` as in ``train``. Each task sends one row of sums; rates without rows are 0.
    """
    s = rows.mapInPandas(_scores(model, k), ", ".join(f"{c} double" for c in _SCORES)).agg(*(F.sum(c).alias(c) for c in _SCORES)).first().asDict()
    over = lambda a, b: float((s[a] or 0.0) / s[b]) if s[b] else 0.0
    return {
        "accuracy": over("right", "n"), "adv_accuracy": over("adv_right", "adv_n"), "adv_margin": over("adv_margin", "adv_n"), "recall_at_k": over("recall", "with_targets"),
        "activation_rate": over("active", "n"), "avg_margin": over("margin", "n"), "avg_weight": float(model.weights().mean()),
    }


def train(model: Selector, rows: DataFrame, dev: DataFrame, epochs: int = 12, rate: float = 0.05, decay: float = 1e-3, similar: np.ndarray | None = None, k: int = 6) -> list[dict[str, float]]:
    """Fit the selector to rows(x, z, adv ARRAY<DOUBLE>, mask DOUBLE): one step of Adam with decoupled decay an epoch, over all rows.

    The loss is the mean of softplus(-margin); where there are hard negatives (mask 1, adv their z) the average of that and
    the same over them; and the mean of alpha D alpha for ``similar`` D. Each task sends one gradient, which Spark sums; no rows reach the driver.
    The model keeps the parameters of the first epoch with the greatest accuracy + 0.25 adv_accuracy + 0.05 recall on ``dev``.
    """
    counts = rows.agg(F.count("*").alias("n"), F.sum("mask").alias("a")).first()
    n, a = counts["n"], counts["a"] or 0.0
    if not n:
        return []
    share = (0.5, 0.5 * n / a) if a else (1.0, 0.0)
    flat = model.flat()
    m, v, best, kept, log = np.zeros_like(flat), np.zeros_like(flat), -np.inf, flat, []
    for epoch in range(1, epochs + 1):
        parts = rows.mapInPandas(_gradients(model, share, similar), _MOMENTS)
        sums = parts.select(F.posexplode("gradient").alias("pos", "g"), "loss").groupBy("pos").agg(F.sum("g").alias("g"), F.sum("loss").alias("loss")).orderBy("pos").collect()
        g = np.array([r["g"] for r in sums]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat * (1 - rate * decay) - rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
        model.load(flat)
        scores = evaluate(model, dev, k)
        log.append({"loss": sums[0]["loss"] / n, **scores})
        worth = scores["accuracy"] + 0.25 * scores["adv_accuracy"] + 0.05 * scores["recall_at_k"]
        if worth > best:
            best, kept = worth, flat
    model.load(kept)
    return log
