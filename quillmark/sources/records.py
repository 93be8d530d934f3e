"""Sources and sinks: record files, preference pairs, rubrics and candidate responses of records, benchmark items; JSON lines out.

Files are read by Spark as text and parsed as VARIANT, so schemas may differ from row to row. The place of a record in its
file is kept in ``line_no``.
"""

from __future__ import annotations

import html
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as D

from quillmark.functions import text as T

# Field names of the parts of a record, in the order in which they are looked for; the first that holds something wins.
PROMPT = ("prompt", "context", "conversation", "conversations", "request_conv", "conversation_history", "messages", "instruction", "question")
CHOSEN = ("chosen", "chosen_response", "chosen_answer", "preferred_response", "response_chosen")
REJECTED = ("rejected", "rejected_response", "rejected_answer", "dispreferred_response", "response_rejected")
IDS = ("example_id", "id", "uid", "uuid")
SELF_RUBRICS = ("prompt_wise_rubrics", "self_generated_rubrics", "self_rubrics")
REFERENCE_RUBRICS = ("reference_rubrics", "oracle_rubrics", "benchmark_rubrics")
CANDIDATES = ("candidate_responses", "response_samples", "sampled_responses", "responses")
# The same for the parts of a rubric, a response and a message, and what may hold responses besides the record.
RUBRIC_TEXT = ("rubric", "text", "criterion", "requirement")
RUBRIC_GROUNDING = ("grounding", "rationale", "reason", "note")
RESPONSE_TEXT = ("response", "response_text", "text", "content", "value")
CONTAINERS = ("meta", "meta_info", "ground_truth")
ROLE = ("role", "from", "speaker")
CONTENT = ("content", "text", "value")
# Official names of the raw domains of one benchmark.
OFFICIAL = {"chat": "Chat", "code": "Code", "math": "Math", "safety-refuse": "Safety", "safety-response": "Safety"}


def numbered(df: DataFrame, name: str, *within: str) -> DataFrame:
    """``df`` with the running index of its rows from 0 in the order in which they are read, over all or in each ``within``.

    Counts per partition are summed to offsets, so no rows are moved. ``df`` must be read alike twice, as files are.
    """
    spot = df.withColumns({"_id": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    by = [*within, "_part"]
    starts = spot.groupBy(*by).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over((W.partitionBy(*within) if within else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = starts.withColumn("_offset", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_n", "_first")
    return spot.join(offsets, by).withColumn(name, F.col("_id") + F.col("_offset")).drop("_id", "_part", "_offset")


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, record VARIANT) of .jsonl, .jsonl.gz and .json files, or of the directories that hold them.

    A .json file holds one object, an array of objects, or an object with such an array under ``data``. line_no is the place
    of a line, or of an element of the array, in its file, from 0; blank lines are counted and skipped. A line or file that
    is no JSON raises an error that names it. Other suffixes raise an error before reading.
    """
    found = [f for p in paths for f in _files(spark, p)]
    if bad := [p for p in found if not p.endswith((".json", ".jsonl", ".jsonl.gz"))]:
        raise ValueError(f"no record files: {bad}")
    parts = []
    if lines := [p for p in found if not p.endswith(".json")]:
        # The blocks of a file come in order only by their start, so lines are numbered in each block, and blocks in each file.
        raw = spark.read.text(lines).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
        of = numbered(raw, "at", "path", "block")
        sizes = raw.groupBy("path", "block").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        at = of.join(sizes.select("path", "block", before.alias("before")), ["path", "block"]).withColumn("line_no", F.col("before") + F.col("at"))
        parts.append(at.where(F.trim("value") != "").select("path", "line_no", _parsed(F.col("value"))))
    if whole := [p for p in found if p.endswith(".json")]:
        raw = spark.read.text(whole, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").select("path", _parsed(F.col("value")))
        kind = F.schema_of_variant("record")
        rows = F.when(kind.startswith("ARRAY"), F.col("record")).otherwise(F.coalesce(F.try_variant_get("record", "$.data", "variant"), F.parse_json(F.concat(F.lit("["), F.to_json("record"), F.lit("]")))))
        exploded = raw.select("path", F.posexplode(F.try_variant_get(rows, "$", "array<variant>")).alias("line_no", "record"))
        parts.append(exploded.select("path", F.col("line_no").cast("long").alias("line_no"), "record"))
    if not parts:
        return spark.createDataFrame([], "path string, line_no long, record variant")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _files(spark: SparkSession, path: str) -> list[str]:
    """A file itself, or the files right in a directory by name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._")


def _parsed(c: Column) -> Column:
    v = F.try_parse_json(c)
    return F.when(v.isNull(), F.raise_error(F.concat(F.lit("no JSON in "), F.col("path"), F.lit(": "), F.substring(c, 1, 80)))).otherwise(v).alias("record")


def kind(v: Column) -> Column:
    """The type of a VARIANT: STRING, BIGINT, ARRAY, OBJECT and so on; VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def member(v: Column | str, name: str) -> Column:
    """A member of a VARIANT as it stands, null if there is none or a JSON null."""
    got = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(kind(got) != "VOID", got)


def string(v: Column) -> Column:
    """A VARIANT's string; null for any other type."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def present(v: Column | str, names: tuple[str, ...]) -> Column:
    """The first of the members that is neither missing, null nor the empty string."""
    return F.coalesce(*(F.when(F.coalesce(string(member(v, n)) != "", F.lit(True)), member(v, n)) for n in names))


def opened(v: Column) -> Column:
    """A VARIANT, or what the JSON in its string holds if that begins with a bracket or brace and can be read."""
    s = string(v)
    return F.coalesce(F.when(s.rlike(r"^\s*[\[{]"), F.try_parse_json(s)), v)


def elements(v: Column) -> Column:
    """The elements of an array as ARRAY<VARIANT>; an object counts as an array of one, anything else is null."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(kind(v) == "OBJECT", F.array(v))


_SPACE_AT_END = re.compile(r"[^\S\n]+$", re.M)


def tidy(text: str) -> str:
    """A text with entities resolved, one kind of line end, and no blanks at the ends of lines or around it."""
    return _SPACE_AT_END.sub("", re.sub(r"\r\n?", "\n", html.unescape(text))).strip()


def _content(message: dict[str, Any]) -> str:
    """What a message says: its first content that is a string, or a list with texts in it."""
    for c in map(message.get, CONTENT):
        parts = [c] if isinstance(c, str) else [p if isinstance(p, str) else (p.get("text") or p.get("content")) for p in c if isinstance(p, str | dict)] if isinstance(c, list) else []
        if isinstance(c, str) or any(isinstance(p, str) for p in parts):
            return tidy("\n".join(p for p in parts if isinstance(p, str)))
    return ""


def _role(message: dict[str, Any]) -> str:
    name = " ".join(str(next((r for r in map(message.get, ROLE) if r), "user")).split()).lower()
    return "assistant" if name in ("assistant", "model", "bot") else "system" if name in ("system", "developer") else "user"


def conversation(value: Any) -> tuple[str, list[dict[str, str]]] | None:
    """The text and the messages of a prompt of any form, None if it holds nothing.

    A string is one message of the user; a list holds strings and messages, shown as ``role: content`` lines; an object is a
    message or holds such a value under prompt, conversation or messages.
    """
    if isinstance(value, str):
        if value.strip()[:1] in ("[", "{"):
            try:
                return conversation(json.loads(value))
            except ValueError:
                pass
        text = tidy(value)
        return text, [{"role": "user", "content": text}]
    if isinstance(value, dict):
        for inner in ("prompt", "conversation", "messages"):
            if inner in value:
                return conversation(value[inner])
        text = _content(value)
        return (text, [{"role": _role(value), "content": text}]) if text else None
    if not isinstance(value, list):
        return None
    each = [{"role": "user", "content": tidy(x)} if isinstance(x, str) else {"role": _role(x), "content": _content(x)} for x in value if isinstance(x, str | dict)]
    each = [m for m in each if m["content"]]
    return (tidy("\n".join(f"{m['role']}: {m['content']}" for m in each)), each) if each else None


_MESSAGE = D.StructType([D.StructField("role", D.StringType()), D.StructField("content", D.StringType())])
_PROMPT = D.StructType([D.StructField("prompt_text", D.StringType()), D.StructField("prompt_messages", D.ArrayType(_MESSAGE))])


@F.pandas_udf(_PROMPT)
def prompt_of(value: pd.Series) -> pd.DataFrame:
    """``conversation`` of JSON values."""
    got = [None if v is None else conversation(json.loads(v)) for v in value]
    return pd.DataFrame({"prompt_text": [g[0] if g else None for g in got], "prompt_messages": [g[1] if g else None for g in got]})


def responses(record: Column | str) -> tuple[Column, Column, Column]:
    """(form, chosen, rejected) of a record, both responses from one form and as they stand.

    ``direct``: fields of those names that are strings; ``signed``: two responses and overall_preference, below 0 for the
    first; ``named``: two responses and the name of the chosen one. ``neutral``: a preference of 0, which has no chosen one.
    Null where there is none of these; a form that does not fit is passed over, but for a neutral one.
    """
    good, bad = string(present(record, CHOSEN)), string(present(record, REJECTED))
    one, two = string(member(record, "response1")), string(member(record, "response2"))
    sign = F.when(kind(member(record, "overall_preference")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.try_variant_get(record, "$.overall_preference", "double"))
    a, b = string(member(record, "response_a")), string(member(record, "response_b"))
    name = F.lower(F.trim(string(member(record, "chosen_candidate"))))
    signed = one.isNotNull() & two.isNotNull() & sign.isNotNull()
    form = (
        F.when(good.isNotNull() & bad.isNotNull(), "direct")
        .when(signed & (sign == 0), "neutral")
        .when(signed & ~F.isnan(sign), "signed")
        .when(a.isNotNull() & b.isNotNull() & name.isin("a", "b"), "named")
    )
    pick = lambda x, first, second, p, q: F.when(form == "direct", x).when(form == "signed", F.when(sign < 0, first).otherwise(second)).when(form == "named", F.when(name == "a", p).otherwise(q))
    return form, pick(good, one, two, a, b), pick(bad, two, one, b, a)


def preferences(records: DataFrame, strict: bool = False) -> DataFrame:
    """(path, line_no, example_id, form, prompt_text, prompt_messages, chosen_response, rejected_response, preference, domain, language) of ``read_records``.

    Texts are cleaned. Neutral records are left out; so are those without a prompt or without two responses, unless
    ``strict``, when they raise an error. Only string ids count; else the id is a hash of the content.
    """
    form, good, bad = responses("record")
    text_id = F.coalesce(*(string(member("record", n)) for n in IDS))
    word = lambda n: F.try_variant_get("record", f"$.{n}", "string")
    rows = records.select(
        "path", "line_no", text_id.alias("own_id"), form.alias("form"), prompt_of(F.to_json(present("record", PROMPT))).alias("p"), T.clean_block(good).alias("chosen_response"), T.clean_block(bad).alias("rejected_response"),
        F.try_variant_get("record", "$.overall_preference", "double").alias("preference"), T.domain(word("domain")).alias("domain"), word("language").alias("language"),
    ).where("form is null or form <> 'neutral'")
    whole = "form is not null and p.prompt_text is not null"
    if strict:
        rows = rows.withColumn("form", F.when(F.expr(whole), F.col("form")).otherwise(F.raise_error(F.concat(F.lit("no prompt or responses in "), "path", F.lit(":"), F.col("line_no").cast("string")))))
    hashed = T.stable_hash(F.concat_ws("\n", "p.prompt_text", "chosen_response", "rejected_response"), "ex-")
    return rows.where(whole).select("path", "line_no", F.coalesce("own_id", hashed).alias("example_id"), "form", "p.*", "chosen_response", "rejected_response", "preference", "domain", "language")


def rubrics(records: DataFrame, key: str, names: tuple[str, ...] = SELF_RUBRICS, source: str = "self") -> DataFrame:
    """(key, pos, text, facet, importance, source, grounding, anchor_id, metadata) of the rubrics in records(key, record VARIANT).

    The first of the fields ``names`` that holds an array, an object, or JSON of these in a string is taken, even if it yields
    nothing; ``prompt_wise_rubrics`` within it is unwrapped. Items are strings or objects; those without text are dropped, and of those with
    the same signature the first stays. ``metadata`` is the rest of an object as JSON. Keys must be unique.
    """
    def listed(name: str) -> Column:
        v = opened(member("record", name))
        inner = F.when(kind(v) == "OBJECT", F.try_variant_get(v, "$.prompt_wise_rubrics", "variant"))
        return F.when(inner.isNotNull(), elements(inner)).otherwise(elements(v))

    items = records.select(key, F.posexplode(F.coalesce(*map(listed, names))).alias("pos", "item"))
    known = (*RUBRIC_TEXT, *RUBRIC_GROUNDING, "facet", "importance", "source", "anchor_id")
    own = F.when(kind(F.col("item")) == "OBJECT", F.col("item"))
    said = F.try_variant_get(member(own, "source"), "$", "string")
    rest = F.map_filter(F.try_variant_get(own, "$", "map<string,variant>"), lambda k, v: ~k.isin(*known))
    rows = items.select(
        key, "pos", T.one_line(F.coalesce(string(F.col("item")), string(present(own, RUBRIC_TEXT)))).alias("text"), T.facet(string(member(own, "facet"))).alias("facet"), T.importance(string(member(own, "importance"))).alias("importance"),
        F.coalesce(F.nullif(F.lower(T.one_line(said)), F.lit("")), F.lit(source)).alias("source"), T.one_line(F.coalesce(string(present(own, RUBRIC_GROUNDING)), F.lit(""))).alias("grounding"),
        string(member(own, "anchor_id")).alias("anchor_id"), F.coalesce(F.to_json(rest), F.lit("{}")).alias("metadata"),
    ).withColumn("signature", T.signature("text"))
    first = F.row_number().over(W.partitionBy(key, "signature").orderBy("pos"))
    return rows.where("signature <> ''").withColumn("_rn", first).where("_rn = 1").drop("_rn", "signature")


def candidate_responses(records: DataFrame, key: str) -> DataFrame:
    """(key, pos, response): the other responses of records(key, record VARIANT), cleaned, without repeats by signature.

    First the response that a signed preference turned down, then the lists under CANDIDATES in the record and its CONTAINERS;
    items are strings or objects that hold one. Responses without letters and digits share one signature. Keys must be unique.
    """
    two = string(member("record", "response1")).isNotNull() & string(member("record", "response2")).isNotNull()
    sign = F.when(two & kind(member("record", "overall_preference")).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN"), F.try_variant_get("record", "$.overall_preference", "double"))
    loser = F.when(sign < 0, string(member("record", "response2"))).when((sign > 0) & ~F.isnan(sign), string(member("record", "response1")))
    # Step by step, so that each value is opened once: the record and its containers, their fields, the items of each.
    holders = F.array(F.col("record"), *(F.when(kind(member("record", c)) == "OBJECT", member("record", c)) for c in CONTAINERS))
    held = records.select(key, F.posexplode(holders).alias("a", "h")).where("h is not null")
    named = held.select(key, "a", F.posexplode(F.array(*(F.try_variant_get("h", f"$.{n}", "variant") for n in CANDIDATES))).alias("b", "v")).where("v is not null")
    each = named.select(key, "a", "b", F.explode(F.array(opened(F.col("v")))).alias("v")).select(key, "a", "b", F.posexplode(elements(F.col("v"))).alias("c", "item"))
    each = each.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("a", "b", "c")) - 1)
    filled = lambda v: F.when(F.trim(string(v)) != "", string(v))
    # Only objects have members to look in.
    said = F.coalesce(filled(F.col("item")), *(filled(member(F.when(kind(F.col("item")) == "OBJECT", F.col("item")), n)) for n in RESPONSE_TEXT))
    first = records.select(key, F.lit(-1).alias("pos"), loser.alias("response")).where("response is not null")
    rows = each.select(key, "pos", said.alias("response")).where("response is not null").unionByName(first).withColumn("response", T.clean_block("response")).where("response <> ''")
    again = F.row_number().over(W.partitionBy(key, T.signature("response")).orderBy("pos"))
    return rows.withColumn("_rn", again).where("_rn = 1").drop("_rn")


def feedback(record: Column | str, people: int = 3, most: int = 6) -> Column:
    """What the first ``people`` annotators wrote, at most ``most`` texts, by blank lines; ``[none]`` without any."""
    listed = F.slice(F.when(kind(member(record, "individual_preference")) == "ARRAY", F.try_variant_get(record, "$.individual_preference", "array<variant>")), 1, people)
    of = lambda p: F.array(*(F.trim(string(member(F.when(kind(p) == "OBJECT", p), n))) for n in ("reasoning", "feedback1", "feedback2")))
    said = F.slice(F.filter(F.flatten(F.transform(listed, of)), lambda x: x != ""), 1, most)
    return F.when(F.size(said) > 0, F.array_join(said, "\n\n")).otherwise("[none]")


def benchmark_items(items: DataFrame, subsets: list[str] | None = None, chosen: int | None = None, rejected: int | None = None) -> DataFrame:
    """(example_id, prompt_text, chosen ARRAY, rejected ARRAY, subset) of items(id, prompt, chosen, rejected, subset).

    Single responses become arrays of one; blank ones are dropped, and items left without either. ``subsets`` filters by
    name or official domain whatever the case. A null id becomes the running index of the rows kept. Counts of completions,
    where the columns are there, default to the arrays' sizes where null or 0. ``chosen`` and ``rejected`` demand so many
    responses and raise otherwise.
    """
    as_list = lambda c: F.col(c) if items.schema[c].dataType.typeName() == "array" else F.array(c)
    clean = lambda c: F.filter(F.transform(as_list(c), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    name = T.domain("subset")
    given = [c for c in ("num_correct", "num_incorrect", "total_completions") if c in items.columns]
    rows = items.select(F.col("id").cast("string").alias("example_id"), F.col("prompt").alias("prompt_text"), clean("chosen").alias("chosen"), clean("rejected").alias("rejected"), name.alias("subset"), *given)
    rows = rows.where((F.size("chosen") > 0) & (F.size("rejected") > 0))
    if subsets is not None:
        wanted = [s.lower() for s in subsets]
        rows = rows.where(F.col("subset").isin(wanted) | F.lower(official_domain("subset")).isin(wanted))
    counted = {"num_correct": F.size("chosen"), "num_incorrect": F.size("rejected"), "total_completions": F.size("chosen") + F.size("rejected")}
    rows = rows.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit(0)), counted[c]) for c in given})
    rows = numbered(rows, "_at").withColumn("example_id", F.coalesce("example_id", F.col("_at").cast("string"))).drop("_at")
    for c, n in (("chosen", chosen), ("rejected", rejected)):
        if n is not None:
            rows = rows.withColumn(c, F.when(F.size(c) == n, F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"not {n} {c} responses in "), "example_id"))))
    return rows


def official_domain(c: Column | str) -> Column:
    """The official name of a raw domain, 'Other' for unknown ones."""
    return F.coalesce(*(F.when(F.lower(T.col(c)) == k, F.lit(v)) for k, v in OFFICIAL.items()), F.lit("Other"))


def candidates_to_pairs(records: DataFrame) -> DataFrame:
    """Records with response_a, response_b and a label as pairs whose A is the chosen one; gold is then always 'a'.

    The label is preferred_candidate or chosen_candidate ('a' or 'b'), else ``label`` (0 is a). A record without any raises.
    """
    named = F.lower(F.coalesce("preferred_candidate", "chosen_candidate"))
    gold = F.when(named.isin("a", "b"), named).when(F.col("label") == 0, "a").when(F.col("label").isNotNull(), "b")
    rows = records.withColumn("gold", F.when(gold.isNull(), F.raise_error(F.lit("a record has neither a candidate nor a label"))).otherwise(gold))
    a, b = F.when(F.col("gold") == "a", F.col("response_a")).otherwise(F.col("response_b")), F.when(F.col("gold") == "a", F.col("response_b")).otherwise(F.col("response_a"))
    return rows.withColumns({"response_a": a, "response_b": b, "gold": F.lit("a")})


def write_json_lines(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object a row, NaN as null, in the order of a column if one is named; the commit is Spark's."""
    numbers = {c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")}
    out = df.withColumns(numbers) if numbers else df
    (out.repartitionByRange(order).sortWithinPartitions(order) if order else out).write.mode("overwrite").json(path)


def read_config(path: str) -> dict:
    """A small JSON file on the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)
