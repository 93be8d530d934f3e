import json

from conftest import rows
from quillmark.operators import drift

SCHEMA = "raw_id long, feed string, file_name string, file_seq int, line_no int, received_at string, raw_record string, path string"


def frame(spark, files, feed="f"):
    out, n = [], 0
    for seq, lines in enumerate(files, 1):
        for i, x in enumerate(lines):
            n += 1
            out.append((n, feed, f"{feed}/{seq}", seq, i, None, x if isinstance(x, str) or x is None else json.dumps(x), "clash"))
    return spark.createDataFrame(out, SCHEMA)


def found(spark, *files):
    df = frame(spark, files)
    return sorted(r[1:] for r in rows(drift.changes(drift.field_facts(df), df).select("feed", "file_name", "change", "field", "new_field")))


def rec(i, **more):
    return {"id": f"x-{i:04d}", "prompt": f"What about number {i} of the list?", "chosen": f"It is the answer to {i}, as far as can be told from here."} | more


def test_changes(spark):
    a = [rec(i, domain=["chat", "code"][i % 2], score=i % 7, tags=["a"], meta={"origin": "lab", "n": 1}) for i in range(20)]
    b = [rec(i, category=["chat", "code"][i % 2], score=str(i % 7), tags=["a"], meta={"origin": "lab", "n": 1}, note="new") for i in range(20)]
    c = [rec(i, category=["chat", "code"][i % 2], score=str(i % 7), tags=[1], meta="flat", note=None) for i in range(20)]
    assert found(spark, a, b, c) == [
        ("f/2", "added", "note", "note"),
        ("f/2", "renamed", "domain", "category"),
        ("f/2", "retyped", "score", "score"),
        ("f/3", "removed", "note", "note"),
        ("f/3", "retyped", "meta", "meta"),
        ("f/3", "retyped", "tags[]", "tags[]"),
    ]


def test_within_a_file_counts_once(spark):
    old = [rec(i, lang=["en", "de"][i % 2]) for i in range(20)]
    mid = old[:8] + [rec(i, locale=["en", "de"][i % 2]) for i in range(8, 20)]
    new = [rec(i, locale=["en", "de"][i % 2]) for i in range(20)]
    assert found(spark, old, mid, new) == [("f/2", "renamed", "lang", "locale")]


def test_moves_with_the_parent(spark):
    a = [rec(i) | {"prompt": [{"role": "user", "content": f"q {i}"}]} for i in range(9)]
    b = [{("messages" if k == "prompt" else k): v for k, v in x.items()} for x in a]
    c = [x | {"messages": [{"role": "user", "content": "q", "turn": 1}]} for x in b]
    d = [x | {"messages": "q"} for x in b]
    assert found(spark, a, b, c, d) == [("f/2", "renamed", "prompt", "messages"), ("f/3", "added", "messages[].turn", "messages[].turn"), ("f/4", "retyped", "messages", "messages")]


def test_lines_that_say_nothing(spark):
    a = [rec(i) for i in range(5)]
    noise = [None, "", "  ", '{"broken": ', "[1]", '"text"', "NaN", '{"x": NaN}']
    assert found(spark, a, [*noise, "﻿" + json.dumps(rec(1)), json.dumps(rec(2) | {"gone": None})], noise, a) == []
    facts = drift.field_facts(frame(spark, []))
    assert rows(drift.changes(facts, frame(spark, []))) == [] and rows(drift.versions(facts)) == []


def test_one_table(spark):
    a = [rec(i, domain="chat", grade=i) for i in range(12)]
    b = [{"uid": i, "question": [{"role": "user", "content": f"What about number {i}"}, {"from": "bot", "text": "hm"}], "chosen_answer": ["two", "parts"], "rejected": None, "preference": "2", "gradeValue": i, "note": {"by": i}} for i in range(12)]
    records = frame(spark, [a, b, ["", "{broken"]])
    facts = drift.field_facts(records)
    changes = drift.changes(facts, records)
    got = {r["raw_id"]: r for r in drift.one_table(records, changes, facts).collect()}
    assert len(got) == 24
    assert got[1]["example_id"] == "x-0000" and got[1]["domain"] == "chat" and json.loads(got[1]["other"]) == {"grade": 0, "note": None}
    assert "default note" in got[1]["rules"] and got[1]["version"] == 1 and got[13]["version"] == 2
    r = got[13]
    assert r["example_id"] == "0" and r["prompt_text"] == "user: What about number 0\nbot: hm" and r["chosen_response"] == "two\nparts" and r["rejected_response"] is None
    assert r["overall_preference"] == 2.0 and r["domain"] == "unknown" and json.loads(r["other"]) == {"grade": 0, "note": {"by": 0}}
    assert [tuple(m) for m in r["prompt_messages"]] == [("user", "What about number 0"), ("bot", "hm")]
    assert any("rename gradeValue -> grade" in x for x in r["rules"]) and any("cast overall_preference" in x for x in r["rules"])
    assert rows(drift.one_table(records.limit(0), changes)) == []


def test_chained_names():
    steps = [(2, "renamed", "a", "b"), (3, "renamed", "b", "c"), (4, "retyped", "c", "c"), (5, "added", "d", "d"), (6, "removed", "e", "e")]
    of = lambda v, seq: (drift.Migration(steps, seq).apply(v, done := []), done)
    assert of({"c": 1, "e": 2}, 3) == ({"a": "1", "e": 2, "d": None}, ["rename c -> a", "cast a to string", "default d"])
    assert of({"b": "x", "e": 2}, 2) == ({"a": "x", "e": 2, "d": None}, ["rename b -> a", "default d"])
    assert of({"c": "x", "d": 1}, 6) == ({"a": "x", "d": 1, "e": None}, ["rename c -> a", "default e"])


def test_nested_names_and_both_names():
    steps = [(2, "renamed", "turns[].text", "turns[].body"), (3, "renamed", "turns", "talk"), (3, "renamed", "topic", "theme"), (4, "renamed", "talk[].who", "talk[].speaker")]
    m = drift.Migration(steps, 4)
    done = []
    assert m.apply({"talk": [{"body": "x", "speaker": "u"}, {"text": "y", "who": "v"}], "theme": "new", "topic": "old"}, done) == {"turns": [{"text": "x", "who": "u"}, {"text": "y", "who": "v"}], "topic": "old", "theme": "new"}
    assert "keep theme beside topic" in done and "rename turns[].body -> turns[].text" in done


def test_rename_in_an_array_of_structs(spark):
    a = [rec(i, turns=[{"text": f"said {i}", "n": 1}]) for i in range(12)]
    b = [rec(i, turns=[{"body": f"said {i}", "n": 1}]) for i in range(12)]
    df = frame(spark, [a, b])
    facts = drift.field_facts(df)
    changes = drift.changes(facts, df)
    assert ("f/2", "renamed", "turns[].text", "turns[].body") in rows(changes.select("file_name", "change", "field", "new_field"))
    other = {r["raw_id"]: json.loads(r["other"])["turns"] for r in drift.one_table(df, changes).collect()}
    assert other[1] == [{"text": "said 0", "n": 1}] and other[13] == [{"text": "said 0", "n": 1}]


def test_likeness_counts_all_values(spark):
    """A small file followed by a large one that has all of its values: sets of unlike size."""
    a = [rec(i, zone=f"z-{i}x{i}") for i in range(24)]
    b = [rec(i, area=f"z-{i}x{i}") for i in range(400)]
    assert found(spark, a, b) == [("f/2", "renamed", "zone", "area")]


def test_versions_count_changes(spark):
    a, b = [rec(1)], [rec(1, extra=1)]
    got = [(r["file_seq"], r["version"]) for r in drift.versions(drift.field_facts(frame(spark, [a, a, b, a]))).orderBy("file_seq").collect()]
    assert got == [(1, 1), (2, 1), (3, 2), (4, 3)]
