"""Requests to a served judge: prompts as columns, samples fanned out over models, rubrics read from replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T


def _section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n"), F.coalesce(body, F.lit("(none)")), F.lit("\n\n"))


def pairwise_prompt(rubrics: Column, note: str = "") -> Column:
    """A prompt that asks for one comparison per rubric, from prompt_text, response_a and response_b; rubrics: an array of texts."""
    listed = F.array_join(F.transform(rubrics, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    task = (
        "Judge two replies to one request. For each numbered criterion say for either reply whether it meets it, and which reply does better; there are no ties. "
        'Reply with JSON alone: {"comparisons": [{"criterion": 1, "a": "pass or fail", "b": "pass or fail", "better": "A or B"}]}. ' + note
    )
    return F.concat(F.lit(task.strip() + "\n\n"), _section("Request", F.col("prompt_text")), _section("Reply A", F.col("response_a")), _section("Reply B", F.col("response_b")), _section("Criteria", listed))


def response_prompt(rubric: Column, response: Column) -> Column:
    """A prompt that asks whether one response meets one rubric; the request itself isn't shown."""
    return F.concat(F.lit("Does the reply below meet the criterion? Answer <EVALUATION>YES</EVALUATION> or <EVALUATION>NO</EVALUATION>.\n\n"), _section("Criterion", rubric), _section("Reply", response))


def fan_out(cases: DataFrame, models: list[str], each: int) -> DataFrame:
    """(..., model, sample): every case ``each`` times for every model, samples numbered from 0 in the order of the models."""
    at = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(k * each + i).alias("sample")) for k, m in enumerate(models) for i in range(each)))).alias("at")
    return cases.select("*", at).select(*cases.columns, "at.*")


def proposed(replies: DataFrame) -> DataFrame:
    """(key, pos, text) of the self-contained rubrics in replies(key, reply); others and failed replies give no row."""
    rows = replies.where("reply is not null").select("key", F.posexplode(T.tagged_items("reply")).alias("pos", "text"))
    return rows.where(T.rubric_issue("text").isNull())
