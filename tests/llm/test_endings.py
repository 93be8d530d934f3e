import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from quillmark.llm import endings, truncation

NOUNS = ["table", "margin", "budget", "report", "ledger"]


def sentences(rng):
    a, b = rng.sample(NOUNS, 2)
    return rng.choice([f"The {a} was copied from the {b} before noon.", f"Nobody has read the {a} because the {b} is closed.", f"Please check the {b} first and then close the {a}.", f"In round {rng.randint(1, 99)} the {a} of Brel{rng.choice('abcde')}na scored lower than the {b}."])


def corpus():
    rng = random.Random(2)
    whole, cut = [], []
    for i in range(600):
        text = " ".join(sentences(rng) for _ in range(rng.randint(2, 6)))
        how = i % 12
        if how == 0:
            words = text.split()
            k = rng.randint(len(words) // 2, len(words) - 2)
            while words[k - 1].endswith(".") or words[k].endswith("."):
                k -= 1
            tail = rng.choice(["", "...", " [...]", "&am", "�"])
            cut.append((i, " ".join(words[:k]) + tail))
        elif how == 1:
            whole.append((i, text[:-1]))  # only the full stop is missing
        elif how == 2:
            whole.append((i, text + "\n- first " + rng.choice(NOUNS) + "\n- second " + rng.choice(NOUNS)))
        elif how == 3:
            whole.append((i, text + f"\nScore: {rng.randint(1, 10)}/10"))
        elif how == 4:
            cut.append((i, text + "\n```python\nx = 1\nfor a in "))
        else:
            whole.append((i, text))
    return whole, cut


def test_cut_and_whole(spark):
    whole, cut = corpus()
    extra = [(9001, None), (9002, ""), (9003, "Ok"), (9004, "Loose table"), (9005, "Complete sentence. " * 3000), (9006, "```\nx\n```")]
    data = [(i, "src", "en", t, "clash") for i, t in whole + cut + extra]
    df = spark.createDataFrame(data, "id long, column string, lang string, text string, class string")
    got = {r["id"]: r["cut"] for r in truncation.truncated(df).collect()}
    assert 9001 not in got and not any(got[i] for i in range(9002, 9007))
    missed = [t[-50:] for i, t in cut if not got[i]]
    wrong = [t[-50:] for i, t in whole if got[i]]
    assert len(missed) <= 0.05 * len(cut), missed
    assert len(wrong) <= 0.02 * len(whole), wrong
    rate = rows(truncation.rates(df))
    assert rate[0][0] == "src" and rate[0][1] == len(data) - 1
    low = truncation.truncated(df, thresholds={("en", "src"): -99.0})
    assert low.where("cut").count() < sum(got.values())


def test_empty(spark):
    df = spark.createDataFrame([], "id long, column string, lang string, text string")
    assert rows(truncation.truncated(df)) == [] and rows(truncation.rates(df)) == []


def test_unclosed_delimiters():
    for cut in ("The margin (see the ledger of May.", 'She asked: "Who has read the report?', "Call `close(table) and then read the report.", "他说「报告已经看过了。", "The value [1, 2 is in the report."):
        assert truncation.verdict(cut)[0] == "cut", cut
    for whole in ("The margin (see the ledger) is low.", 'He said "no" twice.', "A pipe of 5\" is enough for this.", "Use `close(` to end the call.", "Choose a) or b) today.", "x lies in [0, 1) here.", "That was a bad day :(", "“First part.\n\n“Last part.”", "```\nf(\n```\nThat is all there is."):
        assert truncation.verdict(whole)[0] != "cut", whole


def test_thresholds_by_language_and_column(spark):
    odds = {("en", "notes"): [-3.0] * 12 + [4.0] * 188, ("en", "tables"): [-9.0] * 12 + [4.0] * 188, ("de", "notes"): [4.0] * 200, ("zh", "few"): [-9.0] * 5}
    inner = spark.createDataFrame([(lang, column, f"{lang}{column}{i}") for (lang, column), v in odds.items() for i in range(len(v))], "lang string, column string, class string")
    scored = spark.createDataFrame([(f"{lang}{column}{i}", x) for (lang, column), v in odds.items() for i, x in enumerate(v)], "class string, log_odds double")
    got = {(lang, column): own for lang, column, own in rows(truncation._learned(inner, scored, -1.5))}
    assert got[("en", "tables")] < got[("en", "notes")] < -1.5 < got[("de", "notes")] == 0.0 and ("zh", "few") not in got


def test_learned_thresholds_keep_cuts(spark):
    whole, cut = corpus()
    df = spark.createDataFrame([(i, "src", "en", t) for i, t in whole + cut], "id long, column string, lang string, text string")
    got = {r["id"]: r["cut"] for r in truncation.truncated(df, learn=True).collect()}
    assert len(got) == len(whole) + len(cut)
    assert sum(got[i] for i, _ in cut) >= 0.95 * len(cut) and sum(got[i] for i, _ in whole) <= 0.02 * len(whole)


@pytest.mark.parametrize("most", [500, 1 << 20])  # 500, so that counts are handed on many times
def test_no_count_is_forgotten(monkeypatch, most):
    """Each context of a task is counted as often as it occurs, however many contexts there are."""
    monkeypatch.setattr(endings, "MOST_CONTEXTS", most)
    monkeypatch.setattr(endings, "_PIECE", 4_000)
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) + "." for _ in range(300)]
    table = np.full(128, 255, dtype=np.uint8)  # a full bitmap
    want = Counter()
    for p in endings._chunks(texts):
        for keys, _ in p.sought(table):
            want.update(keys.view(np.int64).tolist())
    got = Counter()
    for part in endings._counts(SimpleNamespace(value=table))(iter([pd.DataFrame({"text": texts[:100]}), pd.DataFrame({"text": texts[100:]})])):
        for key, total in zip(part["key"].tolist(), part["total"].tolist(), strict=True):
            got[key] += total
    assert got == want and len(want) > 50_000


def test_no_end_of_a_response_is_forgotten():
    """The ends that p1's responses show after a context are all counted, too, next to what goes on."""
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(12)) + "." for _ in range(300)]
    table = np.full(128, 255, dtype=np.uint8)
    ends = inside = 0
    for p in endings._chunks(texts):
        for _, at in p.sought(table):
            ends, inside = ends + int(p.end[at].sum()), inside + int(p.inside[at].sum())
    got = pd.concat(endings._counts(SimpleNamespace(value=table))(iter([pd.DataFrame({"text": texts})])))
    assert (got["ends"].sum(), got["inside"].sum()) == (ends, inside) and ends > 1000
