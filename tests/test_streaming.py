from conftest import rows
from quillmark.streaming.scoring import score_batch, score_stream

SCHEMA = "record_idx long, example_id string, prompt_text string, language string, domain string, chosen_response string, rejected_response string"


def test_stream_equals_batch(spark, tmp_path):
    data = [(i, f"e{i % 5}", f"prompt {i} table", "en", "chat", f"table {i} answer", f"nothing {i}") for i in range(30)]
    prefs = spark.createDataFrame(data, SCHEMA)
    rubrics = spark.createDataFrame([(i, f"e{i}", 0, "mentions table answer", "format", "major") for i in range(5)], "rubric_id long, example_id string, pos int, text string, facet string, importance string")
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    prefs.where("record_idx < 20").write.parquet(source)

    def run():
        score_stream(spark, source, SCHEMA, rubrics, target, str(tmp_path / "cp")).awaitTermination()

    run()
    prefs.where("record_idx >= 15").write.mode("append").parquet(source)  # some come twice
    run()
    columns = ["record_idx", "side", "source", "margin"]
    assert rows(spark.read.parquet(target).select(columns)) == rows(score_batch(prefs, rubrics).select(columns))
