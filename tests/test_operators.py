import difflib
import inspect
import itertools
import json
import math
import pickle
import random
import types

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillmark.functions.text import STOPWORDS
from quillmark.operators import alike, bank, components, metrics, pairs, recovery, selection, stages, worklist
from quillmark.plans import catalogue


def test_sparsemax_is_the_projection(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(6, 9)) * 2
    z[1] = 0.5  # ties
    df = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(6) for j in range(9)] + [(9, 0, None)], "k int, pos int, z double")
    got = {(r["k"], r["pos"]): r["alpha"] for r in selection.sparsemax(df, "k", "pos", "z").collect()}
    for i in range(6):
        s = np.sort(z[i])[::-1]
        c = np.cumsum(s) - 1
        n = max(k for k in range(1, 10) if s[k - 1] * k > c[k - 1])
        want = np.maximum(z[i] - c[n - 1] / n, 0)
        assert np.allclose([got[i, j] for j in range(9)], want) and math.isclose(want.sum(), 1)
    assert (9, 0) not in got


def test_seeded_split_is_exact(spark):
    for n, want in ((0, 0), (1, 1), (50, 2), (1000, 50)):
        got = selection.seeded_split(spark.range(n), "id", 0.05, 7).where("is_dev")
        assert got.count() == want
    a = rows(selection.seeded_split(spark.range(100), "id", 0.1, 7).where("is_dev").select("id"))
    assert a != rows(selection.seeded_split(spark.range(100), "id", 0.1, 8).where("is_dev").select("id"))


def test_diverse_against_greedy(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    data = [(f"e{e}", 100 * e + i, " ".join(rng.sample(words, 4)), rng.choice(["style", "format"]), float(rng.randint(1, 3))) for e in range(10) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(data, "example_id string, rubric_id long, text string, facet string, weight double")
    got = {(r["example_id"], r["place"]): r["rubric_id"] for r in selection.diverse(df, k=4, same_facet=2).collect()}
    for e in {d[0] for d in data}:
        pool = sorted((d for d in data if d[0] == e), key=lambda d: (-d[4], d[1]))[:18]
        chosen = []
        while len(chosen) < min(4, len(pool)):
            left = [d for d in pool if d not in chosen]
            roomy = [d for d in left if sum(c[3] == d[3] for c in chosen) < 2] or left

            def worth(d, chosen=chosen):
                s = max((len(set(d[2].split()) & set(c[2].split())) / len(set(d[2].split()) | set(c[2].split())) for c in chosen), default=0)
                return d[4] - 0.35 * s - (s >= 0.92)

            chosen.append(max(roomy, key=lambda d: (worth(d), d[4], -d[1])))
        assert [got[e, k + 1] for k in range(len(chosen))] == [d[1] for d in chosen]


def test_selector_gradient_and_training(spark):
    rng = np.random.default_rng(4)
    x, z, adv, mask = rng.normal(size=(40, 5)), rng.normal(size=(40, 4)), rng.normal(size=(40, 4)), rng.integers(0, 2, 40).astype(float)
    similar = np.array([[0, 1.0, 0, 0], [1.0, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]])
    model = selection.Selector(5, 6, 4)
    flat = model.flat()
    grad, _ = model.gradient(x, z, adv, mask, (0.5, 0.7), similar)
    for i in rng.choice(len(flat), 25, replace=False):
        ends = []
        for step in (1e-6, -1e-6):
            moved = flat.copy()
            moved[i] += step
            model.load(moved)
            ends.append(model.gradient(x, z, adv, mask, (0.5, 0.7), similar)[1])
        assert math.isclose((ends[0] - ends[1]) / 2e-6, grad[i], rel_tol=1e-3, abs_tol=1e-5)
    model.load(flat)
    truth = (x[:, :1] > 0) * 1.0  # the first entry is right where the first feature is positive, the second elsewhere
    z = np.hstack([2 * truth - 1, 1 - 2 * truth, np.zeros((40, 2))])
    rows_ = spark.createDataFrame([(a.tolist(), b.tolist(), [0.0] * 4, 0.0) for a, b in zip(x, z, strict=True)], "x array<double>, z array<double>, adv array<double>, mask double")
    log = selection.train(model, rows_, rows_, epochs=25, rate=0.1, k=1)
    assert log[-1]["loss"] < log[0]["loss"] and selection.evaluate(model, rows_, 1)["accuracy"] > 0.9 and selection.evaluate(model, rows_, 1)["recall_at_k"] > 0.9
    assert selection.train(model, rows_.limit(0), rows_) == [] and selection.evaluate(model, rows_.limit(0))["accuracy"] == 0.0


def test_terms_keep_accented_and_chinese_words(spark):
    df = spark.createDataFrame([(1, "Über élan 中文 x", None), (2, None, "x"), (3, "", "y")], "id long, text string, term string")
    assert sorted(rows(selection.terms(df.select("id", "text")))) == [(1, "elan", 1), (1, "elan 中文", 1), (1, "uber", 1), (1, "uber elan", 1), (1, "中文", 1)]


def greedy_leaders(order, score):
    leaders, out = [], {}
    for n in order:
        best = max(((score[n, x], -x) for x in leaders if (n, x) in score), default=None)
        out[n] = n if best is None else -best[1]
        if best is None:
            leaders.append(n)
    return out


def test_leaders_against_the_sequential_ones(spark):
    rng = random.Random(6)
    nodes = list(range(60))
    score = {}
    for a, b in itertools.combinations(nodes, 2):
        if rng.random() < 0.08:
            score[a, b] = score[b, a] = rng.choice([0.9, 0.95])
    order = rng.sample(nodes, 60)
    n = spark.createDataFrame([(x, order.index(x)) for x in nodes], "id long, rank int")
    e = spark.createDataFrame([(a, b, s) for (a, b), s in score.items() if a < b], "a long, b long, score double")
    assert dict(rows(bank.leaders(n, e))) == greedy_leaders(order, score)
    assert dict(rows(bank.leaders(n, e.limit(0)))) == {x: x for x in nodes}


def test_components(spark):
    rng = random.Random(9)
    edges = [("s", *sorted(rng.sample(range(80), 2))) for _ in range(60)] + [("t", 1, 2), ("t", 2, 3), ("t", None, 5), ("t", 7, 7)] + [("c", i, i + 1) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in edges:
        if a is not None and a != b:
            x, y = find((s, a)), find((s, b))
            parent[max(x, y)] = min(x, y)
    want = sorted((s, i, find((s, i))[1]) for s, i in parent)
    got = rows(components.components(spark.createDataFrame(edges, "scope string, a long, b long"), "scope"))
    assert sorted(got) == want
    assert rows(components.components(spark.createDataFrame([], "scope string, a long, b long"), "scope")) == []


def test_similar_pairs_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"t{i}" for i in range(15)]
    data = [(i, " ".join(rng.sample(words, rng.randint(0, 6)))) for i in range(80)] + [(90, None)]
    df = spark.createDataFrame(data, "id long, text string")
    want = set()
    for (i, a), (j, b) in itertools.product(data, data):
        x, y = set((a or "").split()), set((b or "").split())
        if x and y and len(x & y) / len(x | y) >= 0.6 - 1e-9:
            want.add((i, j))
    assert {r[:2] for r in rows(bank.similar_pairs(df, df, 0.6))} == want


def test_collapse_ties_and_blanks(spark):
    data = [(1, "A b!", "tone", "minor", "self", ""), (2, "a  B", "odd", "MAJOR", "llm", "why"), (3, "a b...", None, "major", "llm", None), (4, "...", None, None, None, None), (5, None, None, None, None, None)]
    got = bank.collapse(spark.createDataFrame([(*d, 9) for d in data], "rubric_id long, text string, facet string, importance string, source string, grounding string, signature int")).collect()
    assert len(got) == 1
    assert got[0].asDict() == {"signature": "a b", "observed_count": 3, "text": "a b...", "importance": "major", "facet": "style", "source": "self", "grounding": "why", "first_id": 1}


def test_decisions(spark):
    prefs = spark.createDataFrame([(1, "e", "sum of table", "en", "x", "the table sum", "nothing here", 5), (2, "e", "p", "en", "x", " ", "y", 5), (3, "f", None, "en", None, "x1", "y1", 5)], "record_idx long, example_id string, prompt_text string, language string, domain string, chosen_response string, rejected_response string, margin int")
    rubrics = spark.createDataFrame([(1, "e", 0, "mentions table sum", "format", "critical"), (2, "e", 1, None, None, None)], "rubric_id long, example_id string, pos int, text string, facet string, importance string")
    p = pairs.oriented(prefs)
    d = {r["record_idx"]: r for r in pairs.decide(p, pairs.margins(pairs.comparisons(p, rubrics))).collect()}
    assert set(d) == {1, 3} and d[1]["correct"] and d[1]["source"] == "margin" and d[1]["n_rubrics"] == 2
    assert d[3]["source"] == "direct" and d[3]["side"] == "A" and d[3]["margin"] is None
    summary = metrics.summarize(pairs.decide(p, pairs.margins(pairs.comparisons(p, rubrics))).withColumn("tie", F.abs("margin") <= 0.05), "language").collect()[0]
    assert (summary["total"], summary["usable"], summary["skipped"], summary["correct"]) == (2, 1, 1, 1)


def test_round_robin_and_ties(spark):
    data = [("k", i, float(v)) for i, v in enumerate([1, 5, 2])] + [("one", 0, 3.0)]
    got = {(k, p): s for k, p, s in rows(metrics.round_robin(spark.createDataFrame(data, "key string, pos int, value double"), "key"))}
    for i, v in enumerate([1, 5, 2]):
        assert math.isclose(got["k", i], sum(v - w for j, w in enumerate([1, 5, 2]) if j != i) / 2)
    assert got["one", 0] == 0
    df = spark.createDataFrame([([3.0, 2.0], [1.0]), ([3.0], [4.0])], "c array<double>, i array<double>")
    assert rows(df.select(*metrics.ties_stats(F.col("c"), F.col("i")))) == [(False, None, -1.0), (True, 1.0, 1.0)]


def test_whitened_weights(spark):
    true = [7, 7, 7, 6, 3, 6, 7, 7, 7]
    votes = [("c", s, f"r{r}", float(s == t)) for r, t in enumerate(true) for s in range(8)] + [("single", 0, "a", 1.0), ("single", 0, "b", 0.0)]
    got = {(c, r): w for c, r, w in rows(worklist.whitened_weights(spark.createDataFrame(votes, "case_id string, sample int, rubric string, vote double")))}
    assert [round(got["c", f"r{i}"], 4) for i in range(9)] == [0.7274, 0.7274, 0.7274, 1.3372, 1.9615, 1.3372, 0.7274, 0.7274, 0.7274]
    assert got["single", "a"] == got["single", "b"] == 1.0


def simulate(rubrics, responses, many, depth, rejects):
    import re

    toks = lambda t: [x for x in dict.fromkeys(re.findall("[a-z0-9_]+", t.lower())) if len(x) > 1 and x not in {"the", "and", "of"}]
    out = []
    for case in sorted({r[0] for r in rubrics}):
        queue = [(t, 0) for c, _, t in sorted(rubrics) if c == case]
        seen, accepted, bad = set(), [], 0
        while queue and bad < rejects:
            t, d = queue.pop(0)
            k = t.strip().lower()
            if not k or k in seen:
                bad += 1
                continue
            seen.add(k)
            own = toks(t)
            yes = [(s, bool(own) and sum(x in toks(r) for x in own) / len(own) >= 0.2) for c, r, s in responses if c == case]
            n = sum(y for _, y in yes)
            if n == 0:
                bad += 1
            elif n > many and d < depth:
                parts = [p.strip() for p in re.split(r"[,;]\s+|\s+and\s+", t, maxsplit=1)]
                parts = [p for p in parts if len(p.split()) >= 2]
                if len(parts) == 2:
                    queue += [(p, d + 1) for p in parts]
                else:
                    bad += 1
            elif any(s is False and y for s, y in yes) and not any(s and y for s, y in yes):
                bad += 1
            elif any(sorted(toks(a[2])) == sorted(own) for a in accepted):
                bad += 1
            else:
                accepted.append((case, len(accepted), t, d, n))
        out += accepted
    return out


def test_worklist_against_a_queue(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    phrase = lambda: " ".join(rng.sample(words, 2))
    rubrics = [(f"c{c}", i, rng.choice([phrase(), f"{phrase()}, {phrase()}", f"{phrase()} and {phrase()}; {phrase()}", ""])) for c in range(6) for i in range(6)]
    responses = [(f"c{c}", " ".join(rng.sample(words, rng.randint(1, 4))), s) for c in range(6) for s in (True, False, None)]
    r = spark.createDataFrame(rubrics, "case_id string, pos int, text string")
    a = spark.createDataFrame(responses, "case_id string, text string, strong boolean")
    assert sorted(rows(worklist.refine(r, a, many=1, rejects=4))) == sorted(simulate(rubrics, responses, 1, 3, 4))
    assert rows(worklist.refine(r.limit(0), a)) == []


def test_stage_runs_once_and_appends(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def compute(df):
        def step(batches):
            for b in batches:
                calls.add(len(b))
                yield pd.DataFrame({"key": b["key"], "v": b["n"] * 10})

        return df.mapInPandas(step, "key string, v long")

    items = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("c", 2), (None, 9)], "key string, n long")
    folder = str(tmp_path / "stages")
    assert rows(stages.run_stage(spark, folder, "s", "x", items.where("key <> 'c'"), compute)) == [("a", 0), ("b", 10)]
    first = calls.value
    assert rows(stages.run_stage(spark, folder, "s", "x", items, compute)) == [("a", 0), ("b", 10), ("c", 20)]
    assert calls.value == first + 1
    assert rows(stages.run_stage(spark, folder, "s", "x", items, compute)) == [("a", 0), ("b", 10), ("c", 20)] and calls.value == first + 1


def test_judge_missing_retries_and_reports(spark):
    def client():
        tried = {}

        def ask(prompt):
            tried[prompt] = tried.get(prompt, 0) + 1
            if prompt == "bad" or (prompt == "late" and tried[prompt] < 2):
                raise RuntimeError("no reply")
            return prompt.upper()

        return ask

    df = spark.createDataFrame([("1", "ok"), ("2", "late"), ("3", "bad")], "key string, prompt string").coalesce(1)
    assert rows(stages.judge_missing(df, client, tries=2, pause=0.0)) == [("1", "OK", None), ("2", "LATE", None), ("3", None, "RuntimeError: no reply")]
    keyed = df.select(stages.request_key(F.lit("n"), F.col("prompt")).alias("key"), "prompt")
    assert stages.misses(keyed, keyed.limit(1)).count() == 2
    assert rows(stages.best_round(spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "round int, accuracy double"))) == [(2, 0.7)]


def test_metrics_blocks(spark):
    cells = spark.createDataFrame([("k", i, j, float(i >= j)) for i in range(3) for j in range(3)], "k string, row int, col int, win double")
    assert rows(metrics.matrix(cells, "k")) == [("k", 1.0, 1.0, 0.0, 2 / 3, 9)]
    acc = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("z", 0.0)], "subset string, accuracy double")
    w = spark.createDataFrame([("a", "S", 1), ("b", "S", 3), ("q", "T", 1)], "subset string, section string, weight int")
    assert rows(metrics.section_scores(acc, w, "subset", "section")) == [("S", 0.625, 2)]
    one = spark.createDataFrame([("i", 0.5, [0.1, 0.5]), ("j", 0.9, [0.2]), ("n", 1.0, [])], "item string, chosen double, rejected array<double>")
    assert [r[:4] for r in rows(metrics.best_of_n(one, "item"))] == [("i", False, 2, 1), ("j", True, 1, 1)]
    assert json.dumps(1) and pytest


def test_requests(spark):
    from quillmark.operators import requests

    df = spark.createDataFrame([("q", "one", None, ["c1", "c2"])], "prompt_text string, response_a string, response_b string, rubrics array<string>")
    text = df.select(requests.pairwise_prompt(F.col("rubrics"))).first()[0]
    assert "1. c1\n2. c2" in text and "## Reply B\n(none)" in text
    assert "<EVALUATION>" in df.select(requests.response_prompt(F.lit("c"), F.col("response_a"))).first()[0]
    fan = requests.fan_out(spark.createDataFrame([("x",)], "case_id string"), ["m1", "m2"], 2)
    assert rows(fan) == [("x", "m1", 0), ("x", "m1", 1), ("x", "m2", 2), ("x", "m2", 3)]
    replies = spark.createDataFrame([("k", "<RUBRIC>States the exact total of the bill</RUBRIC><RUBRIC>Refers to the</RUBRIC>"), ("e", None)], "key string, reply string")
    assert rows(requests.proposed(replies)) == [("k", 0, "States the exact total of the bill")]


def test_worklist_has_no_limit_of_rounds():
    # A queue of over 200 rubrics would take minutes here.
    assert "rounds" not in inspect.signature(worklist.refine).parameters and "range(" not in inspect.getsource(worklist.refine)


def test_escalation_beyond_64(spark):
    data = [("p", i, 1.0, 0.0) for i in range(70)] + [("p", 70, 0.9, 71.0)]
    df = spark.createDataFrame(data, "record_idx string, rubric_id long, weight double, delta double")
    assert rows(pairs.escalated(df).select("k", "side")) == [(71, "A")]
    assert rows(pairs.escalated(df, most=64).select("k", "side")) == [(64, None)]


def test_lookup_against_all_pairs(spark):
    rng = random.Random(6)
    base = ["names the ledger of brakvorn before noon", "cites the report number 17 of the archive", "explains why the margin was moved twice", "gives one reason and no more than one"]
    vary = lambda t: "".join(rng.choice("abcdefgh ") if rng.random() < 0.04 else c for c in t)
    items = [(i, vary(rng.choice(base)), rng.choice(["style", "format"])) for i in range(80)] + [(99, None, "style"), (98, "...", None)]
    entries = [(i, vary(rng.choice(base)), rng.choice(["style", "format"])) for i in range(60)]
    a, b = spark.createDataFrame(items, "id long, text string, facet string"), spark.createDataFrame(entries, "id long, text string, facet string")
    got = {(i, j): round(x, 6) for i, j, x in rows(bank.lookup(a, b))}
    sig = lambda t: " ".join("".join(c if c.isalnum() and c.isascii() else " " for c in (t or "").lower()).split())
    tok = lambda t: {w for w in sig(t).split() if len(w) > 1 and w not in STOPWORDS}
    want = {}
    for i, t, f in items:
        equal = [j for j, u, _ in entries if sig(t) and sig(u) == sig(t)]
        if equal:
            want[i, min(equal)] = 1.0
            continue
        for j, u, g in entries:
            if not sig(t):
                continue
            x, y = tok(t), tok(u)
            extra = 0.05 if f == g else 0.0
            s = (len(x & y) / len(x | y) if x and y else 0.0) + extra
            if s < 0.88 - 1e-9:  # characters count only where tokens aren't enough
                s = max(s, difflib.SequenceMatcher(None, sig(t), sig(u)).ratio() + extra)
            if s >= 0.88 - 1e-9:
                want[i, j] = round(s, 6)
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.9 * len(want) > 50
    best = {i: (j, x) for i, j, x in rows(bank.best_match(a, b))}
    assert all(x == min(1.0, max(v for (p, _), v in got.items() if p == i)) or abs(x - max(v for (p, _), v in got.items() if p == i)) < 1e-6 for i, (_, x) in best.items())
    assert rows(bank.lookup(a.limit(0), b)) == [] and rows(bank.lookup(a, b.limit(0))) == []


def test_candidate_ids_in_blocks(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    entries = [(i, " ".join(rng.sample(words, 5))) for i in range(50)] + [(60, None)]
    asked = [(i, " ".join(rng.sample(words, 8))) for i in range(40)] + [(90, "nothing known"), (91, None)]
    b, p = spark.createDataFrame(entries, "bank_id long, text string"), spark.createDataFrame(asked, "id long, text string")
    assert rows(bank.most_overlapping(p, b, block=7)) == rows(bank.most_overlapping(p, b))
    matched = spark.createDataFrame([(0, 7, 2), (0, 3, 1)], "id long, bank_id long, pos int")
    got = {}
    for i, j, n in rows(bank.candidate_ids(p.where("text is not null"), matched, b)):
        got.setdefault(i, {})[n] = j
    assert got[0] == {1: 3, 2: 7} and got[90] == {1: 0, 2: 1, 3: 2, 4: 3}
    sets = {i: set(t.split()) for i, t in entries if t}
    for i, t in asked[1:40]:
        order = sorted(((len(set(t.split()) & s) / len(s), j) for j, s in sets.items()), reverse=True)
        assert [got[i][n] for n in sorted(got[i])] == [j for x, j in order[:4] if x > 0]


def test_prune_top_up(spark):
    df = spark.createDataFrame([(1, 0.5, True), (2, 0.4, False), (3, 0.4, False), (4, 0.1, False)], "bank_id int, score double, keep boolean")
    assert [r[0] for r in bank.top_up(df, 2).where("keep").orderBy("bank_id").collect()] == [1, 2] and bank.top_up(df, 1).where("keep").count() == 1


def test_hints_decide_before_the_direct_judge(spark):
    p = spark.createDataFrame([(i, "e", "alpha", None, None, "x", "alpha", "A") for i in range(4)], "record_idx long, example_id string, prompt_text string, language string, domain string, response_a string, response_b string, gold_side string")
    m = spark.createDataFrame([(0, 1, 0.5, 1), (1, 1, 0.01, 0), (2, 1, 0.0, 0)], "record_idx long, n_rubrics long, margin double, vote long")
    hints = spark.createDataFrame([(0, -9.0), (1, 2.0), (2, 0.0), (3, -1.0)], "record_idx long, hint double")
    got = {r["record_idx"]: (r["side"], r["source"]) for r in pairs.decide(p, m, hints).collect()}
    assert got == {0: ("A", "margin"), 1: ("A", "hint"), 2: ("B", "direct"), 3: ("B", "hint")}


def test_recovery(spark):
    singles = spark.createDataFrame([(1, 0.5), (1, None), (2, None), (3, 0.02), (3, -0.01)], "record_idx long, margin double")
    direct = spark.createDataFrame([(2, "B")], "record_idx long, direct string")
    assert [tuple(r)[1:2] + tuple(r)[3:] for r in recovery.recovered(singles, direct).orderBy("record_idx").collect()] == [(1, "A", "partial"), (0, "B", "direct"), (2, "tie", "recovered")]
    c = spark.createDataFrame([(" b", True, True, None), (None, True, False, "B"), ("tie", True, True, "a"), (None, False, False, None)], "better string, a boolean, b boolean, hint string")
    assert [r[0] for r in c.select(recovery.settled(*(F.col(x) for x in c.columns))).collect()] == ["B", "A", "A", None]
    bank_ = spark.createDataFrame([(1, "old"), (2, "kept"), (3, "kept too")], "bank_id int, text string")
    replies = spark.createDataFrame([(1, 0, "first"), (1, 1, " new "), (2, 0, "x"), (2, 1, " ")], "bank_id int, pos int, text string")
    assert sorted(rows(recovery.rewritten(bank_, replies)), key=repr) == [(1, "new", "old"), (2, "kept", None), (3, "kept too", None)]


def test_benchmark_means(spark):
    by = spark.createDataFrame([("Chat", 1.0, 0.5, 0.0, 0.5), ("Other", 0.0, 0.0, 0.0, 0.0), ("Code", 0.0, 0.5, 1.0, 0.7)], "domain string, easy double, normal double, hard double, all double")
    assert rows(metrics.macro(by)) == [(0.6, 0.5, 0.5, 0.5, 2)] and rows(metrics.macro(by.limit(0)))[0][0] is None
    cells = spark.createDataFrame([("a", i, float(i != "q")) for i in "ppq"], "d string, item string, win double")
    assert rows(metrics.strict(cells, "d")) == [("a", 2, 0.5, 3, 2.0)]
    a = spark.createDataFrame([("x", 1.0), ("y", None)], "subset string, accuracy double")
    assert rows(metrics.mean_of_subsets(a, spark.createDataFrame([("t", 0.5)], "subset string, score double"))) == [(0.5, 3)]


def test_bounds_lose_no_alike_pair():
    """What the bounds on characters drop has a lower ratio, and of unlike texts they drop nearly all before difflib sees them."""
    rng = random.Random(3)
    names = ["".join(rng.choices("bdgklmnrstvz", k=8)) for _ in range(40)]
    base = [f"states the total of {rng.randint(1, 9999)} for {rng.choice(names)} and ranks it against the {rng.choice(names)} schedule {rng.choice(names)} " * rng.choice([1, 1, 2, 6]) for _ in range(60)] + ["x", "0 1"]
    vary = lambda t: "".join(rng.choice("abcdefgh 12") if rng.random() < 0.08 else c for c in t)
    s = [vary(rng.choice(base)) for _ in range(400)]
    t = [vary(rng.choice([x, *base])) for x in s]
    ratio = [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(s, t, strict=True)]
    able = alike._may_be_alike(s, t, 0.83)
    assert all(a or x < 0.83 for a, x in zip(able, ratio, strict=True)) and any(x >= 0.83 for x in ratio)
    unlike = [("".join(rng.choices("abcdefghijklmnop 0123", k=110)), "".join(rng.choices("abcdefghijklmnop 0123", k=110))) for _ in range(200)]
    assert not alike._may_be_alike(*map(list, zip(*unlike, strict=True)), 0.83).any()


def test_a_table_looked_up_in_itself(spark):
    """With equal=False rows don't stand in their own way: before, each matched itself and nothing else."""
    texts = ["names the ledger of brakvorn before noon", "names the ledger of brakvorn before noone", "cites report 17 of the archive"]
    df = spark.createDataFrame([(i, t, "style") for i, t in enumerate(texts)], "id long, text string, facet string")
    assert sorted((a, b) for a, b, _ in rows(bank.lookup(df, df, equal=False))) == [(0, 1), (1, 0)]


def test_reworded_proposals_are_clustered(spark, tmp_path):
    texts = ["Names the ledger of brakvorn before noon.", "Names the ledger of brakvorn before noone!", "Cites report 17 of the archive.", "names the ledger of brakvorn before noon"]
    items = [(i, t, "style", "major", "src", None) for i, t in enumerate(texts)]
    spark.createDataFrame(items, "rubric_id long, text string, facet string, importance string, source string, grounding string").write.parquet(f"{tmp_path}/rubric_items.parquet")
    assert rows(catalogue.queries()["proposal_clusters"](spark, str(tmp_path))) == [(0, 0), (1, 0), (2, 2)]


def token_texts(rng, n):
    words = [f"w{k}" for k in range(14)] + ["often", "always"]
    base = [["often", "always", *rng.sample(words[:14], rng.randint(0, 7))] for _ in range(n // 4)]
    out = [[w for w in rng.choice(base) if rng.random() > 0.1] + ([rng.choice(words)] if rng.random() < 0.4 else []) for _ in range(n)]
    return [(i, " ".join(rng.sample(t, len(t))) if i % 29 else None) for i, t in enumerate(out)]


def overlap_of(x, y):
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize(("least", "limit"), [(0.6, 2), (0.6, 1000), (0.8, 2)])  # 2, so that keys are split up to three tokens
def test_similar_classes_against_all_pairs(spark, least, limit):
    texts = token_texts(random.Random(12), 160)
    members, pairs = bank.similar_classes(spark.createDataFrame(texts, "id long, text string"), least, limit)
    of = {i: frozenset(t.split()) for i, t in texts if t}
    classes = {}
    for i, c in members.collect():
        classes.setdefault(c, set()).add(of[i])
    assert all(len(s) == 1 for s in classes.values()) and len(classes) == len({s for s in of.values() if s})
    own = {c: next(iter(s)) for c, s in classes.items()}
    want = {(a, b, round(overlap_of(own[a], own[b]), 9)) for a in own for b in own if a < b and overlap_of(own[a], own[b]) >= least - 1e-9}
    assert {(a, b, round(x, 9)) for a, b, x in pairs.collect()} == want and len(want) > 20


def test_leaders_of_texts_against_the_sequential_ones(spark):
    rng = random.Random(13)
    texts = token_texts(rng, 160)
    rank = rng.sample(range(160), 160)
    of = {i: frozenset((t or "").split()) for i, t in texts}
    score = {(a, b): x for a in of for b in of if a != b and (x := overlap_of(of[a], of[b])) >= 0.6 - 1e-9}
    df = spark.createDataFrame([(i, t, rank[i]) for i, t in texts], "id long, text string, rank int")
    assert dict(rows(bank.leaders_of_texts(df, 0.6))) == greedy_leaders(sorted(of, key=rank.__getitem__), score)


def test_copies_of_a_text_make_no_pairs(spark):
    """Before, n copies of a text made n * n / 2 links."""
    df = spark.range(3000).selectExpr("id", "'names the ledger of brakvorn' as text", "cast(id as int) as rank")
    members, pairs = bank.similar_classes(df.select("id", "text"), 0.6)
    assert members.count() == 3000 and pairs.count() == 0
    assert bank.leaders_of_texts(df, 0.6).where("leader_id = 0").count() == 3000


def test_most_overlapping_by_frequent_and_other_words(spark):
    """More words than an entry's mask holds: those beyond it are counted by postings, and ties go to larger ids in every block."""
    rng = random.Random(14)
    words = [f"w{k}" for k in range(200)]
    pick = lambda n: " ".join({rng.choice(words[: rng.choice([20, 80, 200])]) for _ in range(n)})
    entries, asked = [(i, pick(6)) for i in range(500)], [(i, pick(10)) for i in range(80)] + [(99, "nothing known")]
    b, p = spark.createDataFrame(entries, "bank_id long, text string"), spark.createDataFrame(asked, "id long, text string")
    sets = {i: set(t.split()) for i, t in entries}
    want = []
    for i, t in asked:
        order = sorted(((len(set(t.split()) & s) / len(s), j) for j, s in sets.items()), reverse=True)
        want += [(i, j, x, n) for n, (x, j) in enumerate(order[:4], 1) if x > 0]
    for block in (1000, 90):
        assert rows(bank.most_overlapping(p, b, block=block)) == sorted(want, key=repr)
    index = bank._index(np.arange(500), [np.array(t.split()) for _, t in entries], 4)
    assert len(index[3]) == 64 and len(index[4]) > 64


def test_an_empty_block_of_entries():
    held = types.SimpleNamespace(value=pickle.dumps(bank._index(np.zeros(0, dtype=np.int64), [], 4)))
    asked = pd.DataFrame({"id": [1], "words": [np.array(["alpha"])]})
    assert [len(b) for b in bank._best_of(held, 4)(iter([asked]))] == [0]


def test_ratio_is_that_of_difflib():
    rng = random.Random(8)
    for _ in range(3000):
        letters = rng.choice(["ab", "abcd ", "abcdefghijklmnopqrstuvwxyz 0"])
        s = "".join(rng.choices(letters, k=rng.choice([0, 1, 7, 30, 90, 230])))
        t = "".join(rng.choice(letters) if rng.random() < 0.1 else c for c in s if rng.random() < 0.95) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.randint(0, 60)))
        assert alike.ratio(s, t) == difflib.SequenceMatcher(None, s, t).ratio()


def test_bundles_compare_a_pair_once(monkeypatch):
    """A pair that shares several keys is compared under the first of them alone, wherever the bundles are parted."""
    texts = ["names the ledger of brakvorn before noon", "names the ledger of brakvorn before noone", "cites report 17 of the archive", "x " * 300]
    xs = [[{"id": i, "text": t.strip(), "before": before} for i, t in enumerate(texts)] for before in ([], ["ledger"], ["other"])]
    ys = [[{"id": 10 + i, "text": t.strip() + " y"} for i, t in enumerate(texts)]] * 3
    batch = pa.record_batch({"xs": pa.array(xs, pa.list_(pa.struct([("id", pa.int64()), ("text", pa.string()), ("before", pa.list_(pa.string()))]))), "ys": pa.array(ys, pa.list_(pa.struct([("id", pa.int64()), ("text", pa.string())])))})
    want = [(i, j) for i, s in enumerate(texts) for j, t in enumerate(texts, 10) if difflib.SequenceMatcher(None, s.strip(), t.strip() + " y").ratio() >= 0.83]
    for held in (1, 10_000):
        monkeypatch.setattr(alike, "_HELD_TEXTS", held)
        got = [(r["sid"], r["tid"]) for b in alike.compared(0.83, 0.88)(iter([batch])) for r in b.to_pylist()]
        assert sorted(got) == sorted([*want, *((i, j) for i, j in want if "ledger" not in texts[j - 10]), *want])


def test_lookup_deals_frequent_keys_over_cells(spark, monkeypatch):
    rng = random.Random(9)
    texts = [f"names the ledger of {rng.choice(['brakvorn', 'trixnor', 'molgad'])} before {rng.choice(['noon', 'dusk', 'dawn'])} {rng.choice(['', 'again', 'twice'])}" for _ in range(60)] + ["a b c", "a b", "b a b"]
    df = spark.createDataFrame([(i, t + "abcdefg"[i % 7], rng.choice(["style", "format"])) for i, t in enumerate(texts)], "id long, text string, facet string")
    for equal in (True, False):
        monkeypatch.setattr(bank, "_EDGE", 128)
        whole = rows(bank.lookup(df, df, equal=equal))
        assert len({(i, j) for i, j, _ in whole}) == len(whole) > 50
        monkeypatch.setattr(bank, "_EDGE", 3)
        assert rows(bank.lookup(df, df, equal=equal)) == whole
