import hashlib
import re

from conftest import rows
from quillmark.functions import text as T
from quillmark.functions.words import code, is_number, words
from pyspark.sql import functions as F


def values(spark, data, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "i int, t string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(df.select("i", *columns).collect())]


def test_words():
    assert words("A&amp;B  x_y Ｚ９​é—Ⅷ") == ["a", "b", "x", "y", "z9é", "viii"]
    assert words(None) == words("") == words("...") == []
    assert is_number("a1") and not is_number("ab")


def test_codes_equal_spark(spark):
    data = ["plain", "ünï", "中文", "7", "a" * 100]
    assert values(spark, data, F.xxhash64("t")) == [code(t) for t in data]


def test_normal_forms(spark):
    data = [None, "", "  A b　 c\n", "x &lt; y  \r\nz\t\n", "Hello , world !"]
    assert values(spark, data, T.one_line("t")) == [None, "", "A b c", "x &lt; y z", "Hello , world !"]
    assert values(spark, data, T.clean_block("t")) == [None, "", "A b　 c", "x < y\nz", "Hello , world !"]
    assert values(spark, data, T.signature("t")) == [None, "", "a b c", "x lt y z", "hello world"]
    assert values(spark, data, T.rubric_text("t")) == ["", "", "A b c", "x &lt; y z", "Hello, world!"]
    assert values(spark, ["The a_b of 7 x1 x1", None], T.tokens("t")) == [["a_b", "x1"], []]
    assert values(spark, ["x"], T.stable_hash("t", "p-")) == ["p-" + hashlib.sha256(b"x").hexdigest()[:16]]


def test_labels_and_tags(spark):
    data = ["Rubric 3: - do  it", "* plain", None, "NEW rubric 2. x"]
    assert values(spark, data, T.without_label("t")) == ["do it", "plain", "", "x"]
    data = ["<RUBRIC> A b </RUBRIC> x <rubric>a B</rubric><rubric>\n- c d</rubric>", "1. first line here\nshort\n* second line here\nGoal: none at all", "", None]
    assert values(spark, data, T.tagged_items("t")) == [["A b", "c d"], ["first line here", "second line here"], [], []]


def test_replies(spark):
    data = ["<EVALUATION> no </EVALUATION> YES", "yes.", "NO, not YES", "nothing", None]
    assert values(spark, data, T.yes_no("t")) == [False, True, None, None, None]
    data = ['x ```json\n{"a": 1}\n``` y', 'say {"b": {"c": 2}} done', "{broken", None]
    assert values(spark, data, T.first_object("t")) == ['{"a": 1}', '{"b": {"c": 2}}', None, None]
    assert values(spark, ["Org/GPT-OSS-120B-high", "other"], T.model_name("t")) == ["gpt-oss-120b", "other"]


def test_orientation_is_the_parity_of_the_hash(spark):
    df = spark.createDataFrame([(str(i), f"good {i}", f"bad {i}") for i in range(50)], "id string, p string, n string")
    for r in df.withColumn("b", T.positive_in_b("id", "p", "n")).collect():
        digest = hashlib.sha256("\n".join(["eval", r["id"], r["p"], r["n"]]).encode()).hexdigest()[:16]
        assert r["b"] == (int(digest, 16) % 2 == 1)


def test_rubric_issues(spark):
    data = [None, " ", "Facet", "the response", "Does the response?", "42 %", "Clarity", "Ends with:", "Names (two things", "Refers to the", "The good code", "The answer states the total", "No extra text", "Is the answer correct?", "Does the response of?", "评分"]
    assert values(spark, data, T.rubric_issue("t")) == [
        "empty_text", "empty_text", "field_label_only", "generic_subject_only", "incomplete_question_stem", "missing_word_tokens", "single_token_fragment", "dangling_terminal", "unbalanced_brackets",
        "dangling_suffix", "bare_subject_fragment", None, None, None, "dangling_suffix", "missing_word_tokens",
    ]
    assert values(spark, [None, "Short", "Does the response?", "A usable rubric text", "An open one here ("], T.still_malformed("t")) == [True, True, True, False, True]


def test_similarity(spark):
    df = spark.createDataFrame([("A b c d", "a b c d"), ("", ""), (None, "x"), ("abc def", "abd def")], "a string, b string")
    got = [r[0] for r in df.select(T.rubric_similarity("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and 0.7 < got[3] < 1
    assert re.match("correctness", rows(df.select(T.facet(F.lit("odd"))).limit(1))[0][0])
    assert rows(df.limit(1).select(T.facet(F.lit(" Tone")), T.facet(F.lit("tool-use")), T.importance(F.lit("MAJOR ")), T.importance(F.lit(None).cast("string")), T.importance_weight(F.lit("critical")))) == [("style", "tool_use", "major", "major", 3.0)]


def test_completion_texts(spark):
    data = [
        '{"choices": [{"text": "plain"}]}', '{"choices": [{"message": {"content": "said"}}]}', '{"choices": [{"message": {"content": [{"text": " a "}, {"x": 1}, {"text": "b"}]}}]}',
        '{"choices": [{"message": {"content": "", "model_extra": {"text": " t ", "answer": "z"}}}]}', '{"choices": [{"index": 0}]}', '{"choices": []}', None,
    ]
    assert values(spark, data, T.completion_text("t")) == ["plain", "said", "a\nb", "t", '{"index":0}', "", None]
