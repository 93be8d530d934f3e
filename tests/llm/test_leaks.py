import json
import random

from conftest import rows
from quillmark.functions.words import words
from quillmark.llm import leaks

ITEMS = [
    (1, "From Bram the amber tram passes 28 shops, a bridge, then cellar 14, where Brun wraps baskets until Tuesday. Answer in one word only and give no reason for the answer at all here."),
    (2, "Answer in one word only and give no reason for the answer at all here. The captain Golad keeps 40 golden pulleys in lighthouse 29, but Kosk repairs any kettles older than 43 weeks."),
    (3, "Zu kurz."),
    (4, None),
]
OWN = {1: ITEMS[0][1].split(". ")[0], 2: ITEMS[1][1].split(". ")[1]}


def frames(spark, docs):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(docs)], "id long, text string, sentence string, item_id int")
    return d, spark.createDataFrame([(*i, "x") for i in ITEMS], "id long, text string, doc_id string")


def test_dress_and_parts(spark):
    s = OWN[1]
    docs = [
        f"Before. {s}. After.",
        s.upper().replace(" ", " ​* "),
        json.dumps({"q": s + '\n"quoted"'}),
        json.dumps(json.dumps({"q": "x\n" + s.replace(" ", "\n")})),
        "<p>" + s.replace(" ", "&nbsp;<b>") + "</p>",
        " ".join(s.split()[:12]),
        " ".join(s.split()[:11]),
        s.replace("passes", "passed"),
        ITEMS[0][1].split(". ")[1],  # shared by two items
        None,
        "",
        "filler " * 5000 + OWN[2] + " filler" * 5000,
    ]
    d, i = frames(spark, docs)
    assert sorted(rows(leaks.leaks(d, i))) == [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 1), (11, 2)]
    assert rows(leaks.leaks(d, i, shard_words=5)) == rows(leaks.leaks(d, i))
    assert rows(leaks.report(d, i)) == [(1, 7), (2, 1)]


def test_empty(spark):
    d, i = frames(spark, ["some text"])
    assert rows(leaks.leaks(d.limit(0), i)) == [] and rows(leaks.leaks(d, i.limit(0))) == []


def test_wand_finds_all_that_reach_their_threshold():
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(50)]
    sentences = [(i, 0, " ".join(rng.choices(vocabulary, k=rng.randint(12, 30)))) for i in range(300)]
    index = leaks.Index(sentences)
    for _ in range(200):
        query = set(rng.choices(vocabulary, k=40))
        score = {x: 0.0 for x in range(len(index.items))}
        for w in query & index.postings.keys():
            at, v, *_ = index.postings[w]
            for x, y in zip(at, v, strict=True):
                score[x] += y
        want = {x for x, s in score.items() if s >= index.threshold[x] - 1e-12}
        assert set(index.retrieve(query)) == want


def test_readings():
    assert ["a", "b"] in leaks.readings("a\\nb") and ["a", "b"] in leaks.readings("<i>a</i>&amp;nbsp;b")
    assert words("a_b") == ["a", "b"]
