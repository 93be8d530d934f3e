"""Queries on the delivered JSON lines: prompts, responses, rubrics and feedback under their varying names and forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.pairs import sql_facet, sql_importance
from quillmark.plans.registry import query
from quillmark.session import table
from quillmark.sources import records as R

READ = """r as (select raw_id, regexp_replace(raw_record, '^\\x{FEFF}', '') as t from raw_records where raw_record is not null and raw_id is not null),
j as (select raw_id, rec from (select raw_id, case when json_valid(t) then t::json end as rec from r) where json_type(rec) = 'OBJECT')"""


def _member(v: str, name: str) -> str:
    return f"(case when json_type({v}, '$.{name}') <> 'NULL' then json_extract({v}, '$.{name}') end)"


def _string(v: str) -> str:
    return f"(case when json_type({v}) = 'VARCHAR' then json_extract_string({v}, '$') end)"


def _present(v: str, names: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"(case when coalesce({_string(_member(v, n))}, 'x') <> '' then {_member(v, n)} end)" for n in names) + ")"


def _opened(v: str) -> str:
    return f"(case when regexp_matches({_string(v)}, '^\\s*[\\[{{]') and json_valid({_string(v)}) then {_string(v)}::json else {v} end)"


def _clean(x: str) -> str:
    """Line ends, blanks and the entities that the table holds; DuckDB has no function for all of them."""
    for entity, c in (("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("amp", "'&'")):
        x = f"replace({x}, '&{entity};', {c})"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\f{_BLANKS}]+$', '', 'g'), '^[\\s{_BLANKS}]+|[\\s{_BLANKS}]+$', '', 'g')"


# Blanks beyond ASCII.
_BLANKS = "\\x{00A0}\\x{3000}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{1680}\\x{2028}\\x{2029}\\x{0085}\\x{000B}"


def _line(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN')"
FORMS = f"""{READ}, p as (select raw_id, rec, {_string(_present("rec", R.CHOSEN))} as good, {_string(_present("rec", R.REJECTED))} as bad, {_string(_member("rec", "response1"))} as one, {_string(_member("rec", "response2"))} as two,
  case when json_type(rec, '$.overall_preference') in {NUMBERS} then case json_extract_string(rec, '$.overall_preference') when 'true' then 1 when 'false' then 0 else try_cast(json_extract_string(rec, '$.overall_preference') as double) end end as sign,
  {_string(_member("rec", "response_a"))} as a, {_string(_member("rec", "response_b"))} as b, lower(trim({_string(_member("rec", "chosen_candidate"))})) as name from j),
f as (select *, case when good is not null and bad is not null then 'direct' when one is not null and two is not null and sign = 0 then 'neutral' when one is not null and two is not null and sign is not null then 'signed'
  when a is not null and b is not null and name in ('a', 'b') then 'named' end as form from p)"""


def _records(spark: SparkSession, where: str) -> DataFrame:
    raw = table(spark, where, "raw_records").where("raw_id is not null").select("raw_id", F.try_parse_json(F.regexp_replace("raw_record", "^﻿", "")).alias("record"))
    return raw.where(R.kind(F.col("record")) == "OBJECT")


@query(f"""with {FORMS} select raw_id, form, {_clean("case form when 'direct' then good when 'signed' then case when sign < 0 then one else two end when 'named' then case when name = 'a' then a else b end end")} as chosen,
{_clean("case form when 'direct' then bad when 'signed' then case when sign < 0 then two else one end when 'named' then case when name = 'a' then b else a end end")} as rejected from f where form is not null""")  # fmt: skip
def delivered_pairs(spark: SparkSession, where: str) -> DataFrame:
    form, good, bad = R.responses("record")
    rows = _records(spark, where).select("raw_id", form.alias("form"), R.T.clean_block(good).alias("chosen"), R.T.clean_block(bad).alias("rejected"))
    return rows.where("form is not null")


_BODY = "coalesce(" + ", ".join(f"(case when json_type(m, '$.{n}') = 'VARCHAR' then json_extract_string(m, '$.{n}') end)" for n in R.CONTENT) + ", '')"
_ROLE = "lower(coalesce(" + ", ".join(f"nullif(json_extract_string(m, '$.{n}'), '')" for n in R.ROLE) + ", 'user'))"


@query(f"""with {READ}, v as (select raw_id, {_present("rec", R.PROMPT)} as v from j), o as (select raw_id, {_opened("v")} as v from v where v is not null),
e as (select raw_id, unnest(json_extract(v, '$[*]')) as m, generate_subscripts(json_extract(v, '$[*]'), 1) as i from o where json_type(v) = 'ARRAY'),
s as (select raw_id, i, case when json_type(m) = 'VARCHAR' then 'user' else case when {_ROLE} in ('assistant', 'model', 'bot') then 'assistant' when {_ROLE} in ('system', 'developer') then 'system' else 'user' end end as role,
  {_clean(f"case when json_type(m) = 'VARCHAR' then json_extract_string(m, '$') else {_BODY} end")} as body from e where json_type(m) in ('VARCHAR', 'OBJECT'))
select raw_id, {_clean("string_agg(role || ': ' || body, chr(10) order by i)")} as prompt_text, count(*)::bigint as n_messages from s where body <> '' group by 1
union all select raw_id, {_clean("json_extract_string(v, '$')")}, 1::bigint from o where json_type(v) = 'VARCHAR'""")  # fmt: skip
def delivered_prompts(spark: SparkSession, where: str) -> DataFrame:
    """The text and number of messages of each line's prompt; prompts that are single objects don't occur in the table."""
    p = _records(spark, where).select("raw_id", R.prompt_of(F.to_json(R.present("record", R.PROMPT))).alias("p"))
    return p.where("p.prompt_text is not null").select("raw_id", "p.prompt_text", F.size("p.prompt_messages").cast("long").alias("n_messages"))


def _listed(name: str) -> str:
    v = _opened(_member("rec", name))
    inner = f"(case when json_type({v}) = 'OBJECT' then json_extract({v}, '$.prompt_wise_rubrics') end)"
    of = lambda x: f"case json_type({x}) when 'ARRAY' then json_extract({x}, '$[*]') when 'OBJECT' then [{x}] end"
    return f"(case when {inner} is not null then {of(inner)} else {of(v)} end)"


_ITEM = f"case when json_type(item) = 'VARCHAR' then json_extract_string(item, '$') when json_type(item) = 'OBJECT' then {_string(_present('item', R.RUBRIC_TEXT))} end"
_SIG = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""with {READ}, l as (select raw_id, coalesce({", ".join(_listed(n) for n in R.SELF_RUBRICS)}) as items from j),
e as (select raw_id, unnest(items) as item, generate_subscripts(items, 1) - 1 as pos from l),
t as (select raw_id, pos, {_line(_ITEM)} as text, {sql_facet("case when json_type(item) = 'OBJECT' then " + _string(_member("item", "facet")) + " end")} as facet,
  {sql_importance("case when json_type(item) = 'OBJECT' then " + _string(_member("item", "importance")) + " end")} as importance from e)
select raw_id, pos::int as pos, text, facet, importance from t where {_SIG} <> '' qualify row_number() over (partition by raw_id, {_SIG} order by pos) = 1""")  # fmt: skip
def delivered_rubrics(spark: SparkSession, where: str) -> DataFrame:
    return R.rubrics(_records(spark, where), "raw_id").select("raw_id", "pos", "text", "facet", "importance")


def _answers(holder: str, name: str) -> str:
    v = _opened(_member(holder, name))
    return f"coalesce(case json_type({v}) when 'ARRAY' then json_extract({v}, '$[*]') when 'OBJECT' then [{v}] end, [])"


_HOLDERS = ["rec", *(f"(case when json_type(rec, '$.{c}') = 'OBJECT' then json_extract(rec, '$.{c}') end)" for c in R.CONTAINERS)]
_SAID = "coalesce(" + ", ".join(f"(case when trim({x}) <> '' then {x} end)" for x in [_string("item"), *(_string(f"(case when json_type(item) = 'OBJECT' then json_extract(item, '$.{n}') end)") for n in R.RESPONSE_TEXT)]) + ")"
_SIGN = f"case when json_type(rec, '$.overall_preference') in {NUMBERS} then try_cast(json_extract_string(rec, '$.overall_preference') as double) end"


@query(f"""with {READ}, l as (select raw_id, {" || ".join(_answers(h, n) for h in _HOLDERS for n in R.CANDIDATES)} as items, {_string(_member("rec", "response1"))} as one, {_string(_member("rec", "response2"))} as two, {_SIGN} as sign from j),
e as (select raw_id, unnest(items) as item, generate_subscripts(items, 1) - 1 as pos from l),
t as (select raw_id, pos, {_clean(_SAID)} as text from e union all select raw_id, -1, {_clean("case when sign < 0 then two when sign > 0 then one end")} from l where one is not null and two is not null)
select raw_id, pos::int as pos, text as response from t where text <> '' qualify row_number() over (partition by raw_id, {_SIG} order by pos) = 1""")  # fmt: skip
def delivered_candidates(spark: SparkSession, where: str) -> DataFrame:
    return R.candidate_responses(_records(spark, where), "raw_id")


_TOLD = "[" + ", ".join(f"trim({_string(_member('p', n))})" for n in ("reasoning", "feedback1", "feedback2")) + "]"


@query(f"""with {READ}, l as (select raw_id, case when json_type(rec, '$.individual_preference') = 'ARRAY' then (json_extract(rec, '$.individual_preference[*]'))[:3] end as people from j),
s as (select raw_id, list_filter(flatten(list_transform(people, lambda p: case when json_type(p) = 'OBJECT' then {_TOLD} else [] end)), lambda x: x is not null and x <> '')[:6] as said from l)
select raw_id, case when len(said) > 0 then array_to_string(said, chr(10) || chr(10)) else '[none]' end as feedback from s""")  # fmt: skip
def delivered_feedback(spark: SparkSession, where: str) -> DataFrame:
    return _records(spark, where).select("raw_id", R.feedback("record").alias("feedback"))
