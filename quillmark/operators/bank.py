"""The global bank: exact collapse, blocked similarity joins, greedy leader clustering, pruning, candidate sets."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import alike as A
from quillmark.session import durable, parallelism, sized, spread


def collapse(rubrics: DataFrame) -> DataFrame:
    """One row for each signature of rubrics(rubric_id, text, facet, importance, source, grounding), blank ones dropped.

    observed_count counts the rows; importance is the greatest; text the longest of the most important rows, the first of
    equals; facet and source come from the first row by rubric_id, grounding from the first that has one. All are
    aggregates that combine before the shuffle, so a signature with very many copies is no burden.
    """
    r = rubrics.select("rubric_id", "text", T.signature("text").alias("signature"), T.facet("facet").alias("facet"), T.importance("importance").alias("importance"), "source", "grounding").where("signature <> ''")
    rank = -T.importance_rank("importance")
    return r.groupBy("signature").agg(
        F.count("*").alias("observed_count"),
        F.max_by("text", F.struct(rank, F.length("text"), -F.col("rubric_id"))).alias("text"),
        F.max_by("importance", rank).alias("importance"),
        F.min_by("facet", "rubric_id").alias("facet"),
        F.min_by("source", "rubric_id").alias("source"),
        F.min_by("grounding", F.when(F.trim("grounding") != "", F.col("rubric_id"))).alias("grounding"),
        F.min("rubric_id").alias("first_id"),
    )


def aliases(rubrics: DataFrame) -> DataFrame:
    """(signature, alias, first_id): the texts of each signature other than the one that ``collapse`` keeps, one row each.

    Rows rather than an array, so that a signature of very many wordings is no one row.
    """
    each = rubrics.select("rubric_id", "text", T.signature("text").alias("signature")).where("signature <> ''")
    kept = collapse(rubrics).select("signature", F.col("text").alias("kept"))
    texts = each.groupBy("signature", F.col("text").alias("alias")).agg(F.min("rubric_id").alias("first_id"))
    return texts.join(kept, "signature").where("alias <> kept").drop("kept")


def largest(collapsed: DataFrame, least_count: int = 1, most: int = 1024) -> DataFrame:
    """The bank of at most ``most`` entries: by count, importance, facet and text, with bank_id from 0 in that order."""
    order = [F.desc("observed_count"), T.importance_rank("importance"), "facet", "text"]
    top = collapsed.where(F.col("observed_count") >= least_count).orderBy(*order).limit(most)
    return top.withColumn("bank_id", F.row_number().over(W.orderBy(*order)) - 1)


def similar_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, overlap) of left(id, text) and right(id, text) whose token overlap is ``least`` or more.

    Tokens are ordered by their frequency on both sides; texts with enough overlap share one of the first
    n - ceil(least * n) + 1, on which they are joined. Only then are the whole token sets compared. Texts without tokens
    are in no pair. ``left`` and ``right`` may be the same table.
    """
    sets = lambda df: df.select("id", T.tokens("text").alias("set")).where(F.size("set") > 0)
    a, b = sets(left), sets(right)
    each = lambda df: df.select("id", F.size("set").alias("n"), F.explode("set").alias("token"))
    # Where it is small the table of frequencies is sent to all tasks, so that frequent tokens aren't shuffled to one for it.
    frequency = sized(durable(each(a).select("token").unionAll(each(b).select("token")).groupBy("token").agg(F.count("*").alias("f"))))
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1

    def prefix(df: DataFrame, name: str) -> DataFrame:
        ranked = each(df).join(frequency, "token").withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("f", "token")))
        return ranked.where(F.col("rank") <= kept).select("token", F.col("id").alias(name), F.col("n").alias(f"n_{name}"))

    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - F.lit(1e-9)
    met = prefix(a, "a").join(prefix(b, "b"), "token").where(near).select("a", "b").distinct()
    both = met.join(a.withColumnsRenamed({"id": "a", "set": "s_a"}), "a").join(b.withColumnsRenamed({"id": "b", "set": "s_b"}), "b")
    return both.withColumn("overlap", T.jaccard("s_a", "s_b")).where(F.col("overlap") >= F.lit(least) - F.lit(1e-9)).select("a", "b", "overlap")


#: Classes that a key of tokens may hold before it is split by one more.
_KEY_LIMIT = 128


def similar_classes(texts: DataFrame, least: float, limit: int = _KEY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The classes (id, class) of texts(id, text) with equal tokens, and the pairs (a, b, score) of classes, a < b, whose overlap is ``least`` or more.

    Tokens stand in one order by rising frequency over the classes. A pair must share need = ceil(least * n) tokens, n being the larger one's,
    hence one of the first n - need + 1, two of the first n - need + 2 and three of the first n - need + 3. Classes meet on
    one token; where more than ``limit`` hold it on two, and where more hold these on three. Texts that may be alike by one token (two)
    alone meet each other on these, however frequent. Pairs that meet are compared in the join, so only those that are alike are shuffled. Texts without tokens are in no class.
    """
    sets = texts.select("id", F.array_sort(T.tokens("text")).alias("set")).where(F.size("set") > 0).withColumn("key", F.concat_ws(" ", "set"))
    classes = durable(sets.groupBy("key").agg(F.first("set").alias("set")).withColumn("class", F.monotonically_increasing_id()))
    members = durable(sets.select("id", "key").join(classes.select("key", "class"), "key").select("id", "class"))
    each = classes.select("class", F.explode("set").alias("token"))
    frequency = sized(durable(each.groupBy("token").agg(F.count("*").alias("f"))))
    ordered = each.join(frequency, "token").groupBy("class").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: F.xxhash64(x["token"])).alias("words"))
    prints = F.expr("aggregate(transform(words, w -> shiftleft(1L, cast(w & 63L as int))), 0L, (a, x) -> a ^ x)")
    need = F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)).cast("int")
    w = durable(ordered.withColumn("n", F.size("words")).select(F.struct("class", "n", prints.alias("print"), "words").alias("x"), (F.col("n") - need).alias("room"), need.alias("need"), "words"))
    tasks = max(parallelism(texts.sparkSession), 4 * texts.sparkSession.sparkContext.defaultParallelism)

    def near(posts: DataFrame) -> DataFrame:
        x, y = F.col("x"), F.col("y")
        met = posts.select("key", "x").repartition(tasks, "key").join(posts.select("key", F.col("x").alias("y")).repartition(tasks, "key"), "key").where(x["class"] < y["class"])
        met = met.where((F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * F.lit(least) - F.lit(1e-9)) & A.may_share_tokens(x, y, least))
        scored = met.select(x["class"].alias("a"), y["class"].alias("b"), T.jaccard(x["words"], y["words"]).alias("score"))
        return scored.where(F.col("score") >= F.lit(least) - F.lit(1e-9))

    def further(posts: DataFrame, share: int) -> DataFrame:
        """The posts with one more token after the last one, of those that a pair with ``share`` tokens in common has among its first."""
        after = F.slice("words", F.col("at") + 2, F.greatest(F.col("room") + share - 1 - F.col("at"), F.lit(0)))
        more = posts.select("key", "x", "room", "need", "words", "at", F.posexplode(after).alias("i", "word"))
        return more.withColumns({"key": F.xxhash64("key", "word"), "at": F.col("at") + 1 + F.col("i")}).drop("i", "word")

    posts = w.select(F.lit(0).cast("long").alias("key"), "x", "room", "need", "words", F.lit(-1).alias("at"))
    pairs = None
    for share in (1, 2, 3):
        posts = further(posts, share)
        if share == 3:
            found = near(posts)
        else:
            hot = durable(posts.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key"))
            found = near(posts.join(sized(hot), "key", "left_anti"))
            posts = posts.join(sized(hot), "key")
            found = found.unionAll(near(posts.where(F.col("need") <= share)))
        pairs = found if pairs is None else pairs.unionAll(found)
        if share < 3 and hot.isEmpty():
            break
    return members, durable(pairs.distinct())


def leaders_of_texts(nodes: DataFrame, least: float) -> DataFrame:
    """``leaders`` of nodes(id, text, rank) linked by a token overlap of ``least``: (id, leader_id).

    Texts with equal tokens have the same links and are linked themselves, so of them none but the first by rank may lead, and
    leaders are found among classes. Each other text then joins the best of the leaders before it that its class is linked to.
    """
    members, pairs = similar_classes(nodes.select("id", "text"), least)
    ranked = durable(members.join(nodes.select("id", "rank"), "id"))
    first = durable(ranked.groupBy("class").agg(F.min_by("id", "rank").alias("leader_id"), F.min("rank").alias("first")))
    chiefs = durable(leaders(first.select(F.col("class").alias("id"), F.col("first").alias("rank")), pairs).where("id = leader_id").select(F.col("id").alias("class")).join(first, "class"))
    both = pairs.select("a", "b", "score").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    links = both.join(chiefs.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("class"), "leader_id", "first", "score")
    links = links.unionByName(chiefs.withColumn("score", F.lit(1.0)))
    best = ranked.join(links, "class").where("rank > first").groupBy("id").agg(F.max_by("leader_id", F.struct("score", -F.col("leader_id"))).alias("leader_id"))
    return nodes.select("id").join(best, "id", "left").select("id", F.coalesce("leader_id", "id").alias("leader_id"))


def matches(candidates: DataFrame, bank: DataFrame, least: float = 0.88, bonus: float = 0.05) -> DataFrame:
    """The best bank entry for each candidate(id, text, facet): (id, bank_id, score), the smallest bank_id of equals.

    The score is the token overlap, 1 for equal signatures, plus ``bonus`` for the same facet; ``least`` or more is a match,
    reported as at most 1.
    """
    pairs = similar_pairs(candidates, bank, least - bonus).select(F.col("a").alias("id"), F.col("b").alias("bank_id"), "overlap")
    ours = candidates.select("id", T.facet("facet").alias("f"), T.signature("text").alias("s"))
    theirs = bank.select(F.col("id").alias("bank_id"), T.facet("facet").alias("g"), T.signature("text").alias("t"))
    score = F.when(F.col("s") == F.col("t"), 1.0).otherwise(F.col("overlap")) + F.when(F.col("f") == F.col("g"), bonus).otherwise(0.0)
    scored = pairs.join(ours, "id").join(theirs, "bank_id").withColumn("score", score).where(F.col("score") >= F.lit(least) - F.lit(1e-9))
    return scored.groupBy("id").agg(F.max_by("bank_id", F.struct("score", -F.col("bank_id"))).alias("bank_id"), F.least(F.lit(1.0), F.max("score")).alias("score"))


def leaders(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Greedy leader clustering of nodes(id, rank) over edges(a, b, score): (id, leader_id), leaders lead themselves.

    In the order of rank (unique) a node joins the best leader before it that it is linked to, the smallest id of equals,
    or becomes one. Done in rounds for all nodes at once: a node leads once every linked node before it is known to follow,
    and follows once one before it leads. Rounds follow the longest chain of links, not the number of nodes.
    """
    ranks = nodes.select("id", "rank")
    both = edges.select("a", "b", "score").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).where("a <> b")
    link = both.join(ranks.withColumnsRenamed({"id": "a", "rank": "r_a"}), "a").join(ranks.withColumnsRenamed({"id": "b", "rank": "r_b"}), "b")
    before = durable(link.where("r_b < r_a").groupBy("a", "b").agg(F.max("score").alias("score")))  # b comes before a
    state = durable(ranks.select("id").join(before.select(F.col("a").alias("id")).distinct(), "id", "left_semi").withColumn("leads", F.lit(None).cast("boolean")))
    free = ranks.select("id").join(state, "id", "left_anti").withColumn("leads", F.lit(True))
    for _ in range(rounds):
        known = state.unionAll(free)
        seen = before.join(known.withColumnsRenamed({"id": "b", "leads": "b_leads"}), "b").groupBy("a").agg(F.bool_or(F.coalesce("b_leads", F.lit(False))).alias("led"), F.bool_or(F.col("b_leads").isNull()).alias("open"))
        new = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.col("led"), False).when(~F.col("open"), True)
        state = durable(state.join(seen, state["id"] == seen["a"], "left").select("id", new.alias("leads")))
        if state.where("leads is null").isEmpty():
            known = state.unionAll(free)
            chiefs = known.where("leads").select(F.col("id").alias("b"))
            joins = before.join(chiefs, "b").groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("leader_id"))
            own = known.where("leads").select("id", F.col("id").alias("leader_id"))
            return own.unionAll(known.where("not leads").join(joins, F.col("id") == F.col("a")).select("id", "leader_id"))
    raise RuntimeError(f"leaders did not settle in {rounds} rounds")


def prune_score(weight: Column, rate: Column, support: Column, observed: Column) -> Column:
    return 4.0 * weight + 2.0 * rate + 0.2 * support + 0.1 * observed


def top_up(scored: DataFrame, least: int) -> DataFrame:
    """``prune_filter``'s rows with ``keep`` set for the best-scored others, too, until ``least`` are kept; smaller ids first among equals."""
    missing = least - scored.where("keep").count()
    if missing <= 0:
        return scored
    more = scored.where("not keep").orderBy(F.desc("score"), "bank_id").limit(missing).select("bank_id", F.lit(True).alias("_more"))
    return scored.join(more, "bank_id", "left").withColumn("keep", F.col("keep") | F.coalesce("_more", F.lit(False))).drop("_more")


def prune_filter(bank: DataFrame, least_weight: float = 0.08, least_rate: float = 0.01) -> DataFrame:
    """bank(bank_id, weight, rate, support_count, observed_count) with its score and whether the filter keeps the entry."""
    keep = (F.col("weight") >= least_weight) | (F.col("rate") >= least_rate) | (F.col("support_count") > 0)
    return bank.withColumns({"score": prune_score(F.col("weight"), F.col("rate"), F.col("support_count"), F.col("observed_count")), "keep": F.coalesce(keep, F.lit(False))})


def new_candidates(existing: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """Rows of ``more`` that ``existing`` lacks by (keys, signature), one for each, the first by id; blank ones dropped."""
    fresh = more.withColumn("signature", T.signature("text")).where("signature <> ''")
    old = existing.select(*keys, T.signature("text").alias("signature")).distinct()
    first = fresh.groupBy(*keys, "signature").agg(F.min("id").alias("id"))
    return first.join(old, [*keys, "signature"], "left_anti")


def _words(c: str) -> Column:
    """The distinct words of a text's signature."""
    return F.filter(F.array_distinct(F.split(T.signature(c), " ")), lambda w: w != "")


def _index(ids: np.ndarray, words: list[np.ndarray], k: int) -> tuple:
    """Of a block of entries: ids, sizes, masks of the 64 most frequent words, each word's bit, and postings of the other words.

    Last the groups of entries of one size and mask: masks, sizes, where the k largest ids of each stand in a list of places, and each entry's group.
    """
    postings: dict[str, list[int]] = {}
    for at, some in enumerate(words):
        for w in some:
            postings.setdefault(w, []).append(at)
    often = sorted(postings, key=lambda w: -len(postings[w]))[:64]
    masks, sizes = np.zeros(len(ids), dtype=np.uint64), np.fromiter(map(len, words), dtype=float, count=len(words))
    for bit, w in enumerate(often):
        masks[postings.pop(w)] |= np.uint64(1 << bit)
    order = np.lexsort((-ids, sizes, masks))
    begins = np.flatnonzero(np.r_[True, (masks[order][1:] != masks[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])][: len(ids)])
    rank = np.arange(len(ids)) - np.repeat(begins, np.diff(np.r_[begins, len(ids)]))
    places = order[rank < k]
    ends = np.cumsum(np.minimum(np.diff(np.r_[begins, len(ids)]), k))
    of = np.empty(len(ids), dtype=np.int32)
    of[order] = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(ids)]))
    groups = (masks[order[begins]], sizes[order[begins]], np.r_[0, ends], places, of)
    return ids, sizes, masks, {w: bit for bit, w in enumerate(often)}, {w: np.array(p, dtype=np.int32) for w, p in postings.items()}, groups


def _best_of(held, k: int, remember: int = 4_000):
    """The step that finds the best k entries of an ``_index`` for each (id, words).

    The best by frequent words alone are found by groups, once for each set of these words. With its other words a prompt
    reaches some entries, of which each is counted in full. An entry that it doesn't reach is among its best only if it is among
    the best by frequent words alone, since no entry's share falls by the other words; for the same reason the share of the
    last of these is a bound under which a reached entry can't be among the best.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sizes, masks, bits, postings, (group_masks, group_sizes, begins, places, of) = pickle.loads(held.value)
        counts = np.zeros(len(ids), dtype=np.uint16)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def best(at: np.ndarray, overlap: np.ndarray) -> np.ndarray:
            return np.lexsort((-ids[at], -overlap))[:k]

        def by_frequent(asked: int) -> tuple[np.ndarray, np.ndarray]:
            """The places of the best k by the frequent words, and how many other words an entry of each group needs to be as good as the last of them."""
            n = np.bitwise_count(group_masks & np.uint64(asked))
            overlap = n / group_sizes
            least = np.partition(overlap, len(overlap) - k)[len(overlap) - k] if len(overlap) > k else 0.0
            some = np.flatnonzero((overlap >= least) & (overlap > 0))
            if not len(some):
                return places[:0], np.zeros(len(n), dtype=np.uint16)
            at = np.concatenate([places[begins[g] : begins[g + 1]] for g in some])
            share = np.repeat(overlap[some], begins[some + 1] - begins[some])
            first = best(at, share)
            bar = float(share[first[-1]]) if len(first) == k else 0.0
            return at[first], np.maximum(np.ceil(bar * group_sizes - n - 1e-6), 0).astype(np.uint16)

        for b in batches:
            out = []
            for i, words in zip(b["id"], b["words"], strict=True):
                asked, others = 0, []
                for w in words:
                    bit = bits.get(w)
                    if bit is not None:
                        asked |= 1 << bit
                    elif (at := postings.get(w)) is not None:
                        others.append(at)
                if asked not in known:
                    if len(known) >= remember:
                        known.clear()
                    known[asked] = by_frequent(asked)
                at, needed = known[asked]
                if others:
                    for more in others:
                        counts[more] += 1
                    reached = np.concatenate(others)
                    at = np.unique(np.concatenate([at, reached[counts[reached] >= needed[of[reached]]]]))
                overlap = (counts[at] + np.bitwise_count(masks[at] & np.uint64(asked))) / sizes[at]
                for more in others:
                    counts[more] = 0
                out += [(i, int(ids[at[j]]), float(overlap[j])) for j in best(at, overlap)]
            yield pd.DataFrame(out, columns=["id", "bank_id", "overlap"])

    return step


def most_overlapping(prompts: DataFrame, bank: DataFrame, k: int = 4, block: int = 131_072) -> DataFrame:
    """(id, bank_id, overlap, rn): the k entries of bank(bank_id, text) of whose words prompts(id BIGINT, text) hold the greatest share, larger ids first among equals.

    The bank is taken in blocks of about ``block`` entries, each sent whole to all tasks as an index of its words; a task
    keeps k entries of each block for a prompt, and only these are shuffled. Entries and prompts without words, or without a common one, are in no row.
    """
    spark = prompts.sparkSession
    entries = durable(bank.where("text is not null and bank_id is not null").select(F.col("bank_id").cast("long").alias("bank_id"), _words("text").alias("words")).where(F.size("words") > 0))
    blocks = max(1, -(-entries.count() // block))
    asked = durable(spread(prompts.where("text is not null and id is not null").select("id", _words("text").alias("words"))))  # read for each block
    found = spark.createDataFrame([], "id long, bank_id long, overlap double")
    for n in range(blocks):
        rows = entries.where(F.pmod(F.xxhash64("bank_id"), F.lit(blocks)) == n).toPandas()  # about ``block`` entries
        index = _index(rows["bank_id"].to_numpy(), list(rows["words"]), k)
        found = found.unionAll(asked.mapInPandas(_best_of(spark.sparkContext.broadcast(pickle.dumps(index)), k), "id long, bank_id long, overlap double"))
    w = W.partitionBy("id").orderBy(F.desc("overlap"), F.desc("bank_id"))
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def candidate_ids(prompts: DataFrame, matched: DataFrame, bank: DataFrame, k: int = 2) -> DataFrame:
    """(id, bank_id, rn): the entries that a prompt's scores are asked for.

    Those matched(id, bank_id, pos) to it, the first 2k by pos; for a prompt without any the max(k, 4) that its words cover
    most (see ``most_overlapping``), and for one without these the first max(k, 4) of the bank by id.
    """
    some, matched = max(k, 4), durable(matched)
    order = F.row_number().over(W.partitionBy("id").orderBy("pos", "bank_id"))
    first = matched.withColumn("rn", order).where(F.col("rn") <= 2 * k).select("id", "bank_id", "rn")
    rest = prompts.join(matched.select("id").distinct(), "id", "left_anti")
    overlapping = durable(most_overlapping(rest, bank, some).select("id", "bank_id", "rn"))
    least = durable(bank.where("text is not null").select("bank_id").orderBy("bank_id").limit(some))
    head = F.explode(F.array(*(F.struct(F.lit(r["bank_id"]).cast("long").alias("bank_id"), F.lit(i).alias("rn")) for i, r in enumerate(least.orderBy("bank_id").collect(), 1)))) if not least.isEmpty() else None
    last = rest.select("id").join(overlapping.select("id").distinct(), "id", "left_anti")
    got = first.unionByName(overlapping)
    return got if head is None else got.unionByName(last.select("id", head.alias("h")).select("id", "h.*"))


#: Rows of either side in a cell of the texts that share a key of ``lookup``.
_EDGE = 128


def lookup(candidates: DataFrame, bank: DataFrame, least: float = 0.88, bonus: float = 0.05, equal: bool = True) -> DataFrame:
    """Pairs (id, bank_id, score) of candidates(id, text, facet) and bank(id, text, facet) entries that are alike by ``least`` or more.

    The score is 1 for equal signatures; else the greater of token overlap and character ratio of the signatures, plus
    ``bonus`` for the same facet. Entries are looked up by a candidate's three rarest tokens of those that few entries hold
    (all in a bank of up to 256, else a sixteenth of it, but 256 to 2,048); without such a token by its rarest one, without
    any by the first 32 characters. Candidates with an equal signature in the bank get its smallest id and aren't looked up; with
    ``equal=False`` equal signatures are no pairs, as where a table is looked up in itself. Signatures are met once, whatever
    their copies and facets, in bundles of texts that share a key (see ``alike``); only what bounds leave open is compared.
    Texts without a signature are in no pair.
    """
    ours = durable(candidates.select("id", T.facet("facet").alias("facet"), T.signature("text").alias("s")).where("s <> ''"))
    theirs = durable(bank.select(F.col("id").alias("bank_id"), T.facet("facet").alias("g"), T.signature("text").alias("t")).where("t <> ''"))
    entries = theirs.count()
    limit = entries if entries <= 256 else min(2048, max(256, entries // 16))
    texts = durable(theirs.groupBy("t").agg(F.count("*").alias("m"), F.min("bank_id").alias("first")).withColumn("tid", F.monotonically_increasing_id()))
    open_ = ours.select("s").distinct()
    if equal:
        open_ = open_.join(texts, F.col("s") == F.col("t"), "left_anti")
    posts = texts.select(F.explode(A.tokens("t")).alias("token"), F.struct(F.col("tid").alias("id"), F.col("t").alias("text")).alias("y"), "m")
    known = durable(posts.groupBy("token").agg(F.sum("m").alias("f")))
    # Tokens are ranked by frequency, so the frequent ones come after all rare ones; the rarest is taken whatever its frequency.
    each = open_.select("s", F.explode_outer(A.tokens("s")).alias("token")).join(sized(known), "token", "left")
    found = F.when(F.col("f").isNotNull(), F.struct("f", (-F.length("token")).alias("l"), "token"))
    keyed = each.groupBy("s").agg(F.slice(F.array_sort(F.collect_list(found)), 1, 3).alias("ranked"))
    keyed = keyed.select("s", F.filter("ranked", lambda x, i: (i == 0) | (x["f"] <= F.lit(limit)))["token"].alias("keys"))
    keyed = durable(keyed.withColumn("sid", F.monotonically_increasing_id()))
    x = lambda before: F.struct(F.col("sid").alias("id"), F.col("s").alias("text"), before.alias("before")).alias("x")
    keys = keyed.select("*", F.posexplode("keys").alias("i", "token")).select("token", x(F.slice("keys", F.lit(1), F.col("i"))))
    bare = keyed.where(F.size("keys") == 0).select(F.substring("s", 1, 32).alias("token"), x(F.array().cast("array<string>")))
    starts = texts.select(F.substring("t", 1, 32).alias("token"), F.struct(F.col("tid").alias("id"), F.col("t").alias("text")).alias("y"))
    # Few and small rows meet in many pairs, so the tasks are as many as the session has at least, whatever the size of their input.
    tasks = max(parallelism(theirs.sparkSession), 4 * theirs.sparkSession.sparkContext.defaultParallelism)

    def near(left: DataFrame, right: DataFrame, counts: DataFrame) -> DataFrame:
        """The pairs of left(token, x) and right(token, y) that are alike; counts(token, a, b) has at least the rows of either.

        A key's rows are dealt over a grid of cells, so that none is large, and the texts of each cell are compared as one bundle.
        """
        cells = lambda n: F.ceil(F.col(n) / F.lit(_EDGE)).cast("int")
        of = lambda c, n: F.pmod(F.xxhash64(f"{c}.text"), cells(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), cells(n) - 1))
        wide = sized(durable(counts))
        xs = left.select("token", "x").join(wide, "token").select("token", "x", of("x", "a").alias("i"), every("b").alias("j"))
        ys = right.select("token", "y").join(wide, "token").select("token", "y", of("y", "b").alias("j"), every("a").alias("i"))
        bundle = lambda df, c: df.repartition(tasks, "token", "i", "j").groupBy("token", "i", "j").agg(F.collect_list(c).alias(f"{c}s"))
        met = bundle(xs, "x").join(bundle(ys, "y"), ["token", "i", "j"]).select("xs", "ys")
        return durable(met.mapInArrow(A.compared(least - bonus, least), "sid long, tid long, overlap double, ratio double"))

    # A pair is compared under the first of the keys it has in common, and ``bare`` texts have none, so no pair comes twice.
    counted = lambda df, name: df.groupBy("token").agg(F.count("*").alias(name))
    alike = near(keys, posts, counted(keys, "a").join(known.withColumnRenamed("f", "b"), "token"))
    if not bare.isEmpty():
        alike = alike.unionAll(near(bare, starts, counted(bare, "a").join(counted(starts, "b"), "token")))
    extra = F.when(F.col("facet") == F.col("g"), bonus).otherwise(0.0)
    enough = lambda c: c + extra >= F.lit(least) - F.lit(1e-9)
    score = F.when(enough(F.col("overlap")), F.col("overlap")).otherwise(F.greatest("overlap", "ratio"))
    entry = theirs.join(texts.select("t", "tid"), "t").select("tid", "bank_id", "g")
    asked = ours.join(keyed.select("s", "sid"), "s").select("sid", "id", "facet")
    best = alike.join(entry, "tid").join(asked, "sid").withColumn("score", score).where(enough(F.col("score"))).select("id", "bank_id", (F.col("score") + extra).alias("score"))
    return best.unionAll(ours.join(texts, F.col("s") == F.col("t")).select("id", F.col("first").alias("bank_id"), F.lit(1.0).alias("score"))) if equal else best


def best_match(candidates: DataFrame, bank: DataFrame, least: float = 0.88, bonus: float = 0.05) -> DataFrame:
    """(id, bank_id, score) of each candidate's best entry by ``lookup``, the smallest bank_id of equals; scores are cut at 1."""
    each = lookup(candidates, bank, least, bonus)
    return each.groupBy("id").agg(F.max_by("bank_id", F.struct(F.round("score", 9), -F.col("bank_id"))).alias("bank_id"), F.least(F.lit(1.0), F.max("score")).alias("score"))
