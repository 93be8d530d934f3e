"""Nulls in every column: no operator fails, and rows that cannot be named give no result."""

from conftest import rows
from quillmark.llm import copies, defects, leaks, packing, similar, splits, truncation


def test_null_ids_and_all_null_rows(spark):
    big = 2**60 + 1  # an id that a float would not hold
    t = "the quick judge reads rubric 12345 and then writes a short note about it"
    four = spark.createDataFrame([(None, None, None, None), ("item", None, t, [t]), (None, 3, t, None), ("item", big, t, [None]), ("item", big + 2, t + " now", None), ("item", big + 4, t.upper(), None)], "scope string, id long, text string, aliases array<string>")
    assert rows(copies.copies(four)) == [("item", big, big + 4)]
    assert rows(similar.look_alikes(four)) == [("item", big, big + 2), ("item", big + 2, big + 4)]
    parts = spark.createDataFrame([(None, None, None, None), (None, "train", "s", t), (big, "train", None, t), (big + 2, "dev", None, t)], "id long, split string, source string, text string")
    assert rows(splits.overlaps(parts)) == [(big, big + 2)]
    assert rows(splits.report(parts)) == [("dev", "unknown", "unknown", 1, 1)]
    docs = spark.createDataFrame([(None, None), (None, t), (big, t)], "id long, text string")
    assert rows(leaks.leaks(docs, docs)) == [(big, big)]
    assert rows(packing.sizes(docs))[0][0] == big
    values = spark.createDataFrame([(None, None, None, None), (None, "c", "en", t), (big, None, None, t + ".")], "id long, column string, lang string, text string")
    assert [(r["id"], r["column"], r["lang"], r["cut"]) for r in truncation.truncated(values).collect()] == [(big, "", "und", False)]
    prefs = spark.createDataFrame([(None, None, None, None), (big, None, None, t + ".")], "record_idx long, prompt_text string, chosen_response string, rejected_response string")
    assert rows(defects.found(prefs)) == [(big, "chosen", "empty")]
