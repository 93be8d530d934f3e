"""Queries on preference pairs and their decisions."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import pairs as P
from quillmark.plans.registry import query
from quillmark.session import table


def stop_list() -> str:
    return ", ".join(f"'{w}'" for w in T.STOPWORDS)


def sql_tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9_]+'), lambda x: length(x) > 1 and x not in ({stop_list()})))"


def sql_facet(c: str) -> str:
    name = f"replace(replace(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '-', '_'), ' ', '_')"
    mapped = f"case {name} " + " ".join(f"when '{k}' then '{v}'" for k, v in T.FACET_ALIASES.items()) + f" else {name} end"
    return f"(case when {mapped} in ({', '.join(repr(f) for f in T.FACETS)}) then {mapped} else 'correctness' end)"


def sql_importance(c: str) -> str:
    name = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"(case when {name} in ('critical', 'major', 'minor') then {name} else 'major' end)"


def sql_weight(c: str) -> str:
    return f"(case {c} when 'critical' then 3.0::double when 'minor' then 1.0::double else 2.0::double end)"


ORIENTED = """
oriented as (
  select record_idx, example_id, prompt_text, language, domain,
         case when swap then rejected_response else chosen_response end as response_a,
         case when swap then chosen_response else rejected_response end as response_b,
         case when swap then 'B' else 'A' end as gold_side
  from (select *, substr(sha256(concat_ws(chr(10), 'eval', coalesce(example_id, ''), chosen_response, rejected_response)), 16, 1) in ('1','3','5','7','9','b','d','f') as swap
        from preferences where trim(chosen_response) <> '' and trim(rejected_response) <> '')
)"""
COMPARED = f"""{ORIENTED},
sides as (select record_idx, example_id, {sql_tokens("response_a")} as t_a, {sql_tokens("response_b")} as t_b from oriented),
asked as (select rubric_id, example_id, pos, {sql_facet("facet")} as facet, {sql_importance("importance")} as importance, {sql_tokens("text")} as t_r from rubric_items),
scored as (
  select record_idx, rubric_id, pos, facet, importance,
         case when len(t_r) = 0 then 0.0::double else len(list_intersect(t_r, t_a))::double / len(t_r) end as score_a,
         case when len(t_r) = 0 then 0.0::double else len(list_intersect(t_r, t_b))::double / len(t_r) end as score_b
  from sides join asked using (example_id)),
compared as (
  select *, {sql_weight("importance")} as weight,
         (score_a >= {P.PASS})::int::double - (score_b >= {P.PASS})::int::double + case when score_a > score_b then 0.25 when score_b > score_a then -0.25 else 0 end as delta
  from scored)"""
DECIDED = f"""{COMPARED},
margins as (select record_idx, count(*) as n_rubrics, sum(weight * delta) / sum(weight) as margin, sum(sign(delta))::bigint as vote from compared group by record_idx),
direct as (
  select record_idx, language, domain, gold_side,
         case when len(t_p) > 0 and len(list_intersect(t_p, t_b)) > len(list_intersect(t_p, t_a)) then 'B' else 'A' end as direct
  from (select *, {sql_tokens("prompt_text")} as t_p, {sql_tokens("response_a")} as t_a, {sql_tokens("response_b")} as t_b from oriented)),
decided as (
  select record_idx, language, domain, gold_side, coalesce(n_rubrics, 0) as n_rubrics, margin, coalesce(vote, 0) as vote, direct,
         case when abs(margin) > {P.TIE} then case when margin > 0 then 'A' else 'B' end else direct end as side,
         case when abs(margin) > {P.TIE} then 'margin' else 'direct' end as source
  from direct left join margins using (record_idx))"""
LANG = "coalesce(nullif(regexp_extract(lower(trim(language)), '^([a-z]{2})(?:[-_].*)?$', 1), ''), 'und')"


def language(c: str = "language"):
    tag = F.regexp_extract(F.lower(F.trim(F.col(c))), r"^([a-z]{2})(?:[-_].*)?$", 1)
    return F.when(tag.isNull() | (tag == ""), "und").otherwise(tag)


def _pairs(spark: SparkSession, where: str) -> DataFrame:
    return P.oriented(table(spark, where, "preferences"))


def _compared(spark: SparkSession, where: str) -> DataFrame:
    return P.comparisons(_pairs(spark, where), table(spark, where, "rubric_items"))


def _decided(spark: SparkSession, where: str, compared: DataFrame | None = None) -> DataFrame:
    return P.decide(_pairs(spark, where), P.margins(_compared(spark, where) if compared is None else compared))


@query(f"with {ORIENTED} select record_idx, gold_side from oriented")
def pair_orientation(spark: SparkSession, where: str) -> DataFrame:
    return _pairs(spark, where).select("record_idx", "gold_side")


@query(f"with {COMPARED} select record_idx, rubric_id, round(score_a, 6) as score_a, round(score_b, 6) as score_b, delta, weight from compared")
def rubric_comparisons(spark: SparkSession, where: str) -> DataFrame:
    return _compared(spark, where).select("record_idx", "rubric_id", F.round("score_a", 6).alias("score_a"), F.round("score_b", 6).alias("score_b"), "delta", "weight")


@query(f"with {DECIDED} select record_idx, n_rubrics::bigint as n_rubrics, round(margin, 6) as margin, side, source from decided")
def pairwise_decisions(spark: SparkSession, where: str) -> DataFrame:
    return _decided(spark, where).select("record_idx", "n_rubrics", F.round("margin", 6).alias("margin"), "side", "source")


@query(f"""with {DECIDED} select {LANG} as language, count(*)::bigint as n_pairs, count(*) filter (where side = gold_side)::bigint as n_correct,
round(avg((side = gold_side)::int), 6) as accuracy from decided group by 1""")  # fmt: skip
def pairwise_accuracy_by_language(spark: SparkSession, where: str) -> DataFrame:
    d = _decided(spark, where).groupBy(language().alias("language"))
    return d.agg(F.count("*").alias("n_pairs"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


_FEW = "n_rubrics > 0 and n_rubrics <= 2"


@query(f"""with {DECIDED}, low as (select *, case when not ({_FEW}) then side when vote > 0 then 'A' when vote < 0 then 'B' else direct end as final,
  case when not ({_FEW}) then source when vote <> 0 then 'vote' else 'direct' end as how from decided)
select how as source, count(*)::bigint as n_pairs, count(*) filter (where final = gold_side)::bigint as n_correct from low group by 1""")  # fmt: skip
def low_evidence_decisions(spark: SparkSession, where: str) -> DataFrame:
    return P.low_evidence(_decided(spark, where)).groupBy("source").agg(F.count("*").alias("n_pairs"), F.count_if("correct").alias("n_correct"))


_VOTES = """votes as (select record_idx, sum(case when rn <= 2 then sign(delta) else 0 end)::bigint as capped_vote, sum(sign(delta))::bigint as vote
  from (select *, row_number() over (partition by record_idx, facet order by pos, rubric_id) as rn from compared) group by 1)"""


@query(f"with {COMPARED}, {_VOTES} select record_idx, capped_vote, vote from votes")
def facet_capped_vote(spark: SparkSession, where: str) -> DataFrame:
    return P.facet_votes(_compared(spark, where))


@query(f"""with {DECIDED}, {_VOTES}, g as (select d.record_idx, d.side, v.capped_vote, v.vote,
  coalesce(sign(v.capped_vote) = sign(v.vote) and v.vote <> 0 and (case when v.vote > 0 then 'A' else 'B' end) <> d.side, false) as flipped
  from decided d left join votes v using (record_idx))
select record_idx, flipped, case when flipped then case side when 'A' then 'B' else 'A' end else side end as side from g""")  # fmt: skip
def redundancy_guard(spark: SparkSession, where: str) -> DataFrame:
    compared = _compared(spark, where).persist(StorageLevel.MEMORY_AND_DISK)
    return P.guarded(_decided(spark, where, compared), P.facet_votes(compared)).select("record_idx", "flipped", "side")


@query(f"""with {COMPARED}, steps as (select record_idx, row_number() over o as k, sum(weight * delta) over (o rows unbounded preceding) / sum(weight) over (o rows unbounded preceding) as margin,
  count(*) over (partition by record_idx) as n from compared window o as (partition by record_idx order by weight desc, rubric_id)),
tried as (select * from steps where k >= 3 or k = n),
best as (select record_idx, coalesce(min(k) filter (where abs(margin) > {P.TIE}), max(k)) as k from tried group by 1)
select record_idx, k::int as k, round(margin, 6) as margin, case when margin > {P.TIE} then 'A' when margin < -{P.TIE} then 'B' end as side from best join tried using (record_idx, k)""")  # fmt: skip
def escalated_decisions(spark: SparkSession, where: str) -> DataFrame:
    return P.escalated(_compared(spark, where)).select("record_idx", "k", F.round("margin", 6).alias("margin"), "side")


@query("""select case when overall_preference is null or isnan(overall_preference) then 'missing' when overall_preference = 0 then 'neutral'
when overall_preference > 0 then 'second' else 'first' end as form, count(*)::bigint as n from preferences group by 1""")  # fmt: skip
def preference_forms(spark: SparkSession, where: str) -> DataFrame:
    p = F.col("overall_preference")
    form = F.when(p.isNull() | F.isnan(p), "missing").when(p == 0, "neutral").when(p > 0, "second").otherwise("first")
    return table(spark, where, "preferences").groupBy(form.alias("form")).agg(F.count("*").alias("n"))


@query("""select coalesce(nullif(lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))), ''), 'unknown') as domain, count(*)::bigint as n,
count(distinct example_id)::bigint as n_examples from preferences group by 1""")  # fmt: skip
def domain_counts(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "preferences").groupBy(T.domain("domain").alias("domain")).agg(F.count("*").alias("n"), F.count_distinct("example_id").alias("n_examples"))


@query("""select record_idx, array_to_string(list_transform(prompt_messages, lambda m:
  (case when lower(m.role) in ('assistant', 'model', 'bot') then 'assistant' when lower(m.role) in ('system', 'developer') then 'system' else 'user' end) || ': ' || m.content), chr(10)) as prompt
from preferences where prompt_messages is not null and len(prompt_messages) > 0""")  # fmt: skip
def conversation_prompt_text(spark: SparkSession, where: str) -> DataFrame:
    role = lambda m: F.when(F.lower(m["role"]).isin("assistant", "model", "bot"), "assistant").when(F.lower(m["role"]).isin("system", "developer"), "system").otherwise("user")
    text = F.array_join(F.transform("prompt_messages", lambda m: F.concat(role(m), F.lit(": "), m["content"])), "\n")
    return table(spark, where, "preferences").where("size(prompt_messages) > 0").select("record_idx", text.alias("prompt"))


@query("""with r as (select example_id, record_idx, rejected_response as response, 0 as pos from preferences where trim(rejected_response) <> ''
union all select example_id, record_idx, chosen_response, 1 from preferences where trim(chosen_response) <> ''),
p as (select example_id, arg_min(prompt_text, record_idx) as prompt_text from preferences where prompt_text is not null group by 1),
s as (select r.*, case when len(t_p) = 0 then 0.0::double else len(list_intersect(t_p, t_r))::double / len(t_p) end as score from (
  select r.example_id, r.record_idx, r.pos, TOK(p.prompt_text) as t_p, TOK(r.response) as t_r from r join p using (example_id)) r)
select example_id, count(*)::bigint as n_pool, arg_max(record_idx, (score, -pos, -record_idx)) as hard_record, round(max(score), 6) as margin from s group by 1
""".replace("TOK(p.prompt_text)", sql_tokens("p.prompt_text")).replace("TOK(r.response)", sql_tokens("r.response")))  # fmt: skip
def hard_negative_argmax(spark: SparkSession, where: str) -> DataFrame:
    """Of the union of an example's responses, the one with the greatest score against its prompt; first wins ties."""
    prefs = table(spark, where, "preferences")
    one = lambda side, pos: prefs.where(F.trim(F.col(side)) != "").select("example_id", "record_idx", F.col(side).alias("response"), F.lit(pos).alias("pos"))
    pool = one("rejected_response", 0).unionAll(one("chosen_response", 1))
    prompts = prefs.where("prompt_text is not null").groupBy("example_id").agg(F.min_by("prompt_text", "record_idx").alias("prompt_text"))
    scored = pool.join(prompts.select("example_id", T.tokens("prompt_text").alias("t_p")), "example_id").withColumn("score", P.share_of("t_p", T.tokens("response")))
    best = F.max_by("record_idx", F.struct("score", -F.col("pos"), -F.col("record_idx")))
    return scored.groupBy("example_id").agg(F.count("*").alias("n_pool"), best.alias("hard_record"), F.round(F.max("score"), 6).alias("margin"))


@query(f"""with {DECIDED} select coalesce(nullif(lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))), ''), 'unknown') as domain, count(*)::bigint as total, count(margin)::bigint as usable, (count(*) - count(margin))::bigint as skipped,
count(*) filter (where margin is not null and side = gold_side)::bigint as correct,
round(count(*) filter (where margin is not null and side = gold_side)::double / nullif(count(margin), 0), 6) as accuracy,
round(count(*) filter (where abs(margin) <= {P.TIE})::double / nullif(count(margin), 0), 6) as tie_rate,
round(sum(case gold_side when 'B' then 0.0 - margin else margin end) / nullif(count(margin), 0), 6) as avg_margin from decided group by 1""")  # fmt: skip
def summary_by_domain(spark: SparkSession, where: str) -> DataFrame:
    from quillmark.operators.metrics import summarize

    d = _decided(spark, where).withColumn("domain", T.domain("domain")).withColumn("tie", F.abs("margin") <= P.TIE)
    s = summarize(d, "domain")
    return s.select("domain", "total", "usable", "skipped", "correct", *(F.round(c, 6).alias(c) for c in ("accuracy", "tie_rate", "avg_margin")))


@query(f"""with {DECIDED}, by_source as (
  select c.record_idx, r.source as rubric_source, sum(c.weight * c.delta) / sum(c.weight) as margin from compared c join (select rubric_id, source from rubric_items) r using (rubric_id) group by 1, 2),
a as (select rubric_source, count(*) as n, avg((margin > {P.TIE} and gold_side = 'A' or margin < -{P.TIE} and gold_side = 'B')::int) as acc from by_source join oriented using (record_idx) group by 1),
s as (select max(case when rubric_source = 'self' then acc end) as self_acc, max(case when rubric_source = 'human' then acc end) as ref_acc from a),
l as (select avg((abs(margin) > {P.TIE} and side = gold_side)::int) as learned_acc from decided)
select round(self_acc, 6) as self_accuracy, round(learned_acc, 6) as learned_accuracy, round(ref_acc, 6) as reference_accuracy,
case when abs(ref_acc - self_acc) > 1e-6 then round((learned_acc - self_acc) / (ref_acc - self_acc), 6) end as gap_closed from s, l""".replace("avg((abs(margin)", "avg((coalesce(abs(margin), 0)"))  # fmt: skip
def gap_closed(spark: SparkSession, where: str) -> DataFrame:
    """Accuracy with self-made, all and human rubrics, and the share of the gap between the first and the last that all close."""
    plain = _compared(spark, where).persist(StorageLevel.MEMORY_AND_DISK)
    compared = plain.join(table(spark, where, "rubric_items").select("rubric_id", F.col("source").alias("rubric_source")), "rubric_id")
    margin = (F.sum(F.col("weight") * F.col("delta")) / F.sum("weight")).alias("margin")
    gold = _pairs(spark, where).select("record_idx", "gold_side")
    right = ((F.col("margin") > P.TIE) & (F.col("gold_side") == "A")) | ((F.col("margin") < -P.TIE) & (F.col("gold_side") == "B"))
    by = compared.groupBy("record_idx", "rubric_source").agg(margin).join(gold, "record_idx").groupBy("rubric_source").agg(F.avg(right.cast("int")).alias("acc"))
    ends = by.agg(F.max(F.when(F.col("rubric_source") == "self", F.col("acc"))).alias("s"), F.max(F.when(F.col("rubric_source") == "human", F.col("acc"))).alias("r"))
    learned = _decided(spark, where, plain).agg(F.avg(((F.coalesce(F.abs("margin"), F.lit(0.0)) > P.TIE) & F.col("correct")).cast("int")).alias("l"))
    none = F.lit(None).cast("double")
    rows = ends.select("s", "r", none.alias("l")).unionAll(learned.select(none, none, "l"))  # one row each
    both = rows.agg(F.max("s").alias("s"), F.max("r").alias("r"), F.max("l").alias("l"))
    gap = F.when(F.abs(F.col("r") - F.col("s")) > 1e-6, F.round((F.col("l") - F.col("s")) / (F.col("r") - F.col("s")), 6))
    return both.select(F.round("s", 6).alias("self_accuracy"), F.round("l", 6).alias("learned_accuracy"), F.round("r", 6).alias("reference_accuracy"), gap.alias("gap_closed"))
