import random

import pytest
from conftest import rows
from quillmark.functions.words import is_number, words
from quillmark.llm import filters, splits

SCHEMA = "id long, split string, source string, text string, class string"


def brute(data, overlap=0.75):
    recs = [(i, s == "train", set(words(t))) for i, s, _, t in data if t is not None and s is not None and words(t)]
    out = set()
    for i, x, a in recs:
        for j, y, b in recs:
            if x and not y and i != j:
                n = len(a & b)
                if {w for w in a if is_number(w)} == {w for w in b if is_number(w)} and n >= overlap * (len(a) + len(b) - n) - 1e-9:
                    out.add((min(i, j), max(i, j)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [128, 4])  # 4, so that small data has frequent keys of all kinds
def test_against_brute_force(spark, monkeypatch, limit):
    if limit == 4:
        monkeypatch.setattr(filters, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(splits, "TRIPLED", 9)
        monkeypatch.setattr(splits, "PAIRED", 12)
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["7", "88"]
    base = [rng.sample(vocabulary, rng.randint(1, 40)) for _ in range(40)]
    data = []
    for i in range(500):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        data.append((i, rng.choice(["train", "train", "dev", "test", None]), rng.choice(["a", "b", None]), " ".join(w) if i % 40 else rng.choice([None, "", "...", "long " * 20000])))
    data += [(1000 + i, "train" if i % 3 else "test", "a", "hot prompt 5") for i in range(60)]
    df = spark.createDataFrame([(*d, "clash") for d in data], SCHEMA)
    want = brute(data)
    assert rows(splits.overlaps(df, limit=limit)) == want and len(want) > 800
    report = rows(splits.report(df))
    assert sum(r[3] for r in report) == len(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(splits.overlaps(df)) == [] and rows(splits.report(df)) == []


def test_levels_cover_all_size_pairs():
    starts = splits.level_starts(0.75, 500)
    level = lambda n: max(k for k, s in enumerate(starts) if s <= n)
    for n in range(1, 300):
        for m in range(n, int(n / 0.75) + 1):
            assert level(m) - level(n) <= 1
            at = level(n)
            assert splits.radius(0.75, n + m) <= splits.radius(0.75, starts[at + 1] - 1 + starts[at + 2] - 1)


def test_rows_a_text_stay_flat_without_numbers(spark):
    """Prompts without numbers, of words drawn from a skewed vocabulary: what meets grows with the texts, not with their square."""
    rng = random.Random(7)
    vocabulary = [f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}x" for k in range(5000)]
    weights = [1 / (k + 2) for k in range(5000)]
    each = []
    for n in (1000, 4000):
        data = [(i, "train" if i % 2 else "test", "s", " ".join(rng.choices(vocabulary, weights, k=rng.randint(20, 44))), None) for i in range(2 * n)]
        cold, cells = splits._posts(splits.prints(spark.createDataFrame(data, SCHEMA)), splits.LIMIT)
        met = splits._in_groups(cold).count()
        for posts, counts in cells:
            met += posts.where("not train").select("key").join(posts.where("train").select("key"), "key").count()
        each.append(met / n)
    print(each)
    assert each[1] < 2 * each[0] + 300
