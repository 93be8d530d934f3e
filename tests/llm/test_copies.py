import collections

import pytest
from hypothesis import given
from hypothesis import strategies as st

from conftest import rows
from quillmark.llm import copies

SCHEMA = "scope string, id long, text string, key string, kept_id string"


def brute(data):
    groups = collections.defaultdict(list)
    for scope, id_, text in data:
        if text is not None:
            groups[scope, copies.canonical(text)].append(id_)
    return sorted((s, min(v), x) for (s, _), v in groups.items() for x in v if x != min(v))


def frame(spark, data):
    return spark.createDataFrame([(*d, "clash", "clash") for d in data], SCHEMA)


def test_dress():
    same = ["The  Answer, is 12!", "the answer is 12", "THE answer​ &amp; is: 12", "Ｔｈｅ answer is １２"]
    assert len({copies.canonical(t) for t in same}) == 1
    assert copies.canonical('{"a": "X y", "b": [1, {"c": 2, "d": "e"}]}') == copies.canonical('{ "b":[1,{"d":"E","c":2}],"a":"x Y" }')
    assert copies.canonical("Criterion: x y | Facet: z") == copies.canonical("facet: Z | criterion: X, y")
    assert copies.canonical("a: b | no label") == "abnolabel"
    assert copies.canonical(None) is None and copies.canonical("...") == copies.canonical("") == ""
    assert copies.canonical("{broken") == "broken"


@given(st.lists(st.sampled_from(["a", "B", "1", "é", "中"]), max_size=8), st.lists(st.sampled_from([" ", "-", ", ", "​"]), min_size=8, max_size=8))
def test_spacing_never_matters(letters, marks):
    assert copies.canonical("".join(letters)) == copies.canonical("".join(a + b for a, b in zip(letters, marks, strict=False)))


@pytest.mark.parametrize("hot", [1, 40])
def test_against_brute_force(spark, hot):
    texts = [None, "", "...", "One two", "one-two", "ONE TWO", "x" * 20000, "X" * 20000, '{"a":1,"b":"c"}', '{"b":"C","a":1}']
    data = [(s, n * 2 + (s == "bank"), texts[n % len(texts)]) for s in ("item", "bank") for n in range(60)] + [("item", 1000 + n, "Hot text") for n in range(hot * 30)]
    got = rows(copies.copies(frame(spark, data)))
    assert got == sorted(brute(data), key=repr)
    reps = {(s, k): n for s, k, n in rows(copies.representatives(frame(spark, data)))}
    assert sum(reps.values()) == sum(t is not None for *_, t in data)
    assert reps["item", 1000] == hot * 30


def test_empty_and_repeated_ids(spark):
    assert rows(copies.copies(frame(spark, []))) == []
    assert rows(copies.copies(frame(spark, [("item", 1, "a"), ("item", 1, "A"), ("item", 2, "a")]))) == [("item", 1, 2)]
