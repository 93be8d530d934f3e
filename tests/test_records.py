import gzip
import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quillmark.sources import records as R


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_reads_all_kinds(spark, tmp_path):
    put(tmp_path / "a.jsonl", '{"n": 1}\n\n  \n{"n": 2, "x": [1]}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"n": 3}\n')
    put(tmp_path / "c.json", '[{"n": 4}, {"n": 5}]')
    put(tmp_path / "d.json", '{"data": [{"n": 6}]}')
    put(tmp_path / "e.json", '{"n": 7}')
    put(tmp_path / "_SUCCESS", "")
    (tmp_path / "sub").mkdir()
    put(tmp_path / "sub" / "x.jsonl", '{"n": 99}')
    got = R.read_records(spark, str(tmp_path)).select(F.variant_get("record", "$.n", "int")).collect()
    assert sorted(r[0] for r in got) == [1, 2, 3, 4, 5, 6, 7]
    at = R.read_records(spark, str(tmp_path)).select(F.variant_get("record", "$.n", "int"), "line_no").collect()
    assert dict(map(tuple, at)) == {1: 0, 2: 3, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0}


def test_line_numbers_over_blocks(spark, tmp_path):
    path = put(tmp_path / "big.jsonl", "".join(f'{{"n": {i}}}\n' for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = R.read_records(spark, path).select(F.variant_get("record", "$.n", "long"), "line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and all(a == b for a, b in got)


def test_fails_fast(spark, tmp_path):
    bad = put(tmp_path / "bad.jsonl", '{"n": 1}\n{broken\n')
    with pytest.raises(Exception, match="no JSON in"):
        R.read_records(spark, bad).collect()
    with pytest.raises(ValueError, match="no record files"):
        R.read_records(spark, put(tmp_path / "x.json.gz", ""))
    with pytest.raises(FileNotFoundError):
        R.read_records(spark, str(tmp_path / "none.jsonl"))


def test_preferences(spark, tmp_path):
    lines = [
        {"id": "a", "prompt": "p", "chosen": "c", "rejected": "r", "domain": " Chat "},
        {"id": 5, "prompt": "", "context": "ctx", "response1": "one", "response2": "two", "overall_preference": -1},
        {"uid": "u", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "x"}], "response1": "one", "response2": "two", "overall_preference": 2},
        {"uid": "n", "prompt": "p", "response1": "one", "response2": "two", "overall_preference": 0},
        {"uid": "k", "prompt": "p", "response_a": "one", "response_b": "two", "chosen_candidate": "B"},
        {"uid": "m", "chosen": "c", "rejected": "r"},
    ]
    path = put(tmp_path / "p.jsonl", "\n".join(map(json.dumps, lines)))
    got = {r["example_id"]: r for r in R.preferences(R.read_records(spark, path)).collect()}
    assert len(got) == 4 and got["a"]["domain"] == "chat"
    assert got["u"]["chosen_response"] == "two" and got["u"]["prompt_text"] == "user: q\nassistant: x"
    assert got["k"]["chosen_response"] == "two" and got["k"]["rejected_response"] == "one"
    hashed = next(r for k, r in got.items() if k.startswith("ex-"))
    assert hashed["prompt_text"] == "ctx" and hashed["chosen_response"] == "one"


def test_benchmark_items(spark):
    df = spark.createDataFrame([(1, "p", "c", ["r1", " ", None], "Math"), (2, "p", " ", ["r"], "math"), (3, "p", "c", ["r", "s"], "Chat")], "id long, prompt string, chosen string, rejected array<string>, subset string")
    assert rows(R.benchmark_items(df)) == [("1", "p", ["c"], ["r1"], "math"), ("3", "p", ["c"], ["r", "s"], "chat")]
    assert [r[0] for r in rows(R.benchmark_items(df, subsets=["MATH"]))] == ["1"]
    with pytest.raises(Exception, match="not 2 rejected"):
        R.benchmark_items(df, rejected=2).collect()
    assert rows(df.select(R.official_domain("subset")).distinct()) == [("Chat",), ("Math",)]


def test_candidates_to_pairs(spark):
    df = spark.createDataFrame([("a", "A1", "B1", "a", None, None), ("b", "A2", "B2", None, "b", None), ("c", "A3", "B3", None, None, 1)], "case_id string, response_a string, response_b string, preferred_candidate string, chosen_candidate string, label int")
    assert [(r[0], r[1], r[2], r[-1]) for r in rows(R.candidates_to_pairs(df))] == [("a", "A1", "B1", "a"), ("b", "B2", "A2", "a"), ("c", "B3", "A3", "a")]
    with pytest.raises(Exception, match="neither"):
        R.candidates_to_pairs(df.limit(1).withColumn("preferred_candidate", F.lit(None).cast("string"))).collect()


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, float("nan"), "b"), (1, 1.5, "a")], "n int, x double, t string")
    R.write_json_lines(df, str(tmp_path / "out"), "n")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"n": 1, "x": 1.5, "t": "a"}, {"n": 2, "t": "b"}]
    assert R.read_config(put(tmp_path / "c.json", '{"k": 1}')) == {"k": 1}


def frame(spark, values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id long, raw string").select("id", F.parse_json("raw").alias("record"))


def test_forms_are_not_mixed(spark):
    df = frame(spark, [
        {"chosen_answer": "one", "preferred_response": "two", "rejected": "no"},
        {"chosen": "c", "response_a": "x", "response_b": "y", "chosen_candidate": "b"},
        {"response1": "x &amp; z", "response2": "y", "overall_preference": 0, "response_a": "p", "response_b": "q", "chosen_candidate": "a"},
        {"response1": "x", "response2": "y", "overall_preference": "2"},
        {"chosen": "", "chosen_response": "c", "rejected": ["r"], "response1": "x", "response2": "y", "overall_preference": True},
    ])
    form, good, bad = R.responses("record")
    assert [tuple(r) for r in df.select("id", form, good, bad).orderBy("id").collect()] == [(0, "direct", "one", "no"), (1, "named", "y", "x"), (2, "neutral", None, None), (3, None, None, None), (4, "signed", "y", "x")]


def test_conversations():
    assert R.conversation("  a &lt; b \r\n c ") == ("a < b\n c", [{"role": "user", "content": "a < b\n c"}])
    assert R.conversation('["x", {"from": "Bot", "value": "y"}, 7, {"role": "developer", "content": [{"text": "p"}, "q", {}]}]')[0] == "user: x\nassistant: y\nsystem: p\nq"
    assert R.conversation({"conversation": {"messages": [{"speaker": "user", "text": "hi"}]}})[0] == "user: hi"
    assert R.conversation({"role": "model", "content": "done"}) == ("done", [{"role": "assistant", "content": "done"}])
    assert R.conversation([]) is None and R.conversation(5) is None and R.conversation({"content": ""}) is None
    assert R.conversation("[broken")[0] == "[broken"


def test_rubrics_and_candidates(spark):
    df = frame(spark, [
        {"self_rubrics": ["Name the place.", "name the place", " ", {"criterion": "Give a reason", "facet": "tone", "importance": "Critical", "reason": "r", "x": 1, "source": " Human "}, 5]},
        {"self_generated_rubrics": '["in a string"]', "self_rubrics": ["not looked at"]},
        {"prompt_wise_rubrics": None, "self_generated_rubrics": {"prompt_wise_rubrics": [{"text": "deep"}]}},
        {"prompt_wise_rubrics": [], "self_rubrics": ["hidden by an empty list"]},
        {"self_rubrics": "plain words"},
    ])
    got = [tuple(r)[:6] for r in R.rubrics(df, "id").orderBy("id", "pos").collect()]
    assert got == [(0, 0, "Name the place.", "correctness", "major", "self"), (0, 3, "Give a reason", "style", "critical", "human"), (1, 0, "in a string", "correctness", "major", "self"), (2, 0, "deep", "correctness", "major", "self")]
    assert R.rubrics(df, "id").where("pos = 3").select("grounding", "metadata").first() == ("r", '{"x":1}')
    df = frame(spark, [
        {"response1": "lost", "response2": "won", "overall_preference": 2, "responses": ["Lost!", "a &amp; b", {"text": " ", "value": "v"}], "meta": {"sampled_responses": '["...", "--", "last"]'}},
        {"meta": "none", "responses": {"response": "single"}},
        {},
    ])
    assert [tuple(r) for r in R.candidate_responses(df, "id").orderBy("id", "pos").collect()] == [(0, -1, "lost"), (0, 1, "a & b"), (0, 2, "v"), (0, 3, "..."), (0, 5, "last"), (1, 0, "single")]


def test_feedback(spark):
    one = {"reasoning": " r ", "feedback1": "", "feedback2": "f"}
    df = frame(spark, [{"individual_preference": [one, "no", one, {"reasoning": "late"}]}, {"individual_preference": None}, {}])
    assert [r[0] for r in df.orderBy("id").select(R.feedback("record")).collect()] == ["r\n\nf\n\nr\n\nf", "[none]", "[none]"]


def test_running_index_for_null_ids(spark):
    df = spark.createDataFrame([(None, "p", ["c"], ["r"], "Code", 0), (None, "p", [" "], ["r"], "math", 4), (None, "p", ["c"], ["r", "s"], "chat", None)], "id long, prompt string, chosen array<string>, rejected array<string>, subset string, total_completions int")
    got = R.benchmark_items(df.coalesce(1)).select("example_id", "subset", "total_completions")
    assert rows(got) == [("0", "code", 2), ("1", "chat", 3)]
    assert rows(R.benchmark_items(df, subsets=["Math", "CODE"]).select("subset")) == [("code",)]
