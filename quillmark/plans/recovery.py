"""Queries on comparisons put right, recovered decisions, selected and mined rubrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import bank as B
from quillmark.operators import pairs as P
from quillmark.operators import recovery as R
from quillmark.plans.bank import SIG
from quillmark.plans.pairs import DECIDED, _compared, _decided, _pairs, sql_facet, sql_tokens
from quillmark.plans.registry import query
from quillmark.session import table

SETTLED = f"""{DECIDED}, settled as (select c.*, d.gold_side, d.direct, c.score_a >= {P.PASS} as pass_a, c.score_b >= {P.PASS} as pass_b,
  case when c.score_a > c.score_b then 'A' when c.score_b > c.score_a then 'B' when c.score_a >= {P.PASS} and not c.score_b >= {P.PASS} then 'A' when c.score_b >= {P.PASS} and not c.score_a >= {P.PASS} then 'B'
    when c.importance = 'critical' then d.direct end as better from compared c join direct d using (record_idx))"""


def _settled(spark: SparkSession, where: str) -> DataFrame:
    """The comparisons with the better side settled; for critical rubrics the direct judge's side is the hint."""
    direct = P.decide(_pairs(spark, where), P.margins(_compared(spark, where))).select("record_idx", "gold_side", "direct")
    c = _compared(spark, where).join(direct, "record_idx")
    return c.withColumn("better", R.settled(F.col("better"), F.col("pass_a"), F.col("pass_b"), F.when(F.col("importance") == "critical", F.col("direct"))))


@query(f"with {SETTLED} select record_idx, rubric_id, better from settled where better is not null")
def settled_comparisons(spark: SparkSession, where: str) -> DataFrame:
    return _settled(spark, where).where("better is not null").select("record_idx", "rubric_id", "better")


@query(f"""with {SETTLED}, n as (select record_idx, count(*) as selected, count(better) as compared from settled group by 1)
select record_idx, selected::bigint as selected, compared::bigint as compared, selected = compared as covered from n""")  # fmt: skip
def rubric_coverage(spark: SparkSession, where: str) -> DataFrame:
    n = _settled(spark, where).groupBy("record_idx").agg(F.count("*").alias("selected"), F.count("better").alias("compared"))
    return n.withColumn("covered", R.covered(F.col("selected"), F.col("compared"), F.col("selected")))


@query(f"""with {SETTLED}, s as (select record_idx, any_value(direct) as direct, count(*) as n, count(better) as k, sum(case when better is not null then weight * delta end) as margin from settled group by 1)
select record_idx, k::bigint as n_recovered, round(margin, 6) as margin, case when k = 0 then direct when margin > {P.TIE} then 'A' when margin < -{P.TIE} then 'B' else 'tie' end as side,
case when k = 0 then 'direct' when k < n then 'partial' else 'recovered' end as source from s where k < n""")  # fmt: skip
def recovered_decisions(spark: SparkSession, where: str) -> DataFrame:
    """Pairs some of whose comparisons were not settled, decided by the rest."""
    s = _settled(spark, where)
    singles = s.select("record_idx", F.when(F.col("better").isNotNull(), F.col("weight") * F.col("delta")).alias("margin"))
    direct = s.groupBy("record_idx").agg(F.first("direct").alias("direct"))
    return R.recovered(singles, direct).where("source <> 'recovered'").withColumn("margin", F.round("margin", 6))


@query(f"""with {SETTLED} select record_idx, rubric_id, round(case gold_side when 'B' then score_b else score_a end, 6) as score_chosen, round(case gold_side when 'B' then score_a else score_b end, 6) as score_rejected,
case gold_side when 'B' then 0.0 - delta else delta end as delta_vs_chosen, case when better = gold_side then 'chosen' when better is not null then 'rejected' end as better_position from settled""")  # fmt: skip
def labelled_comparisons(spark: SparkSession, where: str) -> DataFrame:
    rows = R.labelled(_settled(spark, where))
    return rows.select("record_idx", "rubric_id", F.round("score_chosen", 6).alias("score_chosen"), F.round("score_rejected", 6).alias("score_rejected"), "delta_vs_chosen", "better_position")


@query(f"""with {DECIDED}, h as (select c.record_idx, sum(c.weight * c.delta) / sum(c.weight) as margin from compared c join (select rubric_id, source from rubric_items) r using (rubric_id) where r.source = 'human' group by 1),
e as (select d.record_idx, d.side = d.gold_side as own, case when abs(h.margin) > {P.TIE} then case when h.margin > 0 then 'A' else 'B' end else d.direct end = d.gold_side as ref, d.domain from decided d left join h using (record_idx))
select coalesce(nullif(lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))), ''), 'unknown') as domain, count(*)::bigint as n, count(*) filter (where own)::bigint as own_correct, count(*) filter (where ref)::bigint as reference_correct, count(*) filter (where own and ref)::bigint as both_correct from e group by 1""")  # fmt: skip
def decision_details(spark: SparkSession, where: str) -> DataFrame:
    """Decisions by all rubrics beside those by human ones alone, record by record, counted by domain."""
    human = table(spark, where, "rubric_items").where("source = 'human'")
    reference = P.decide(_pairs(spark, where), P.margins(P.comparisons(_pairs(spark, where), human)))
    rows = R.details(_decided(spark, where), reference, "domain", "side", "correct").groupBy(T.domain("own.domain").alias("domain"))
    return rows.agg(F.count("*").alias("n"), F.count_if("own.correct").alias("own_correct"), F.count_if("reference.correct").alias("reference_correct"), F.count_if(F.col("own.correct") & F.col("reference.correct")).alias("both_correct"))


def _malformed(c: str) -> str:
    x = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    return f"(length({x}) < 12 or right({x}, 1) = '(' or regexp_replace(lower({x}), '[.?]*$', '') in ({', '.join(repr(t) for t in T.BARE_STEMS)}))"


@query(f"""with s as (select r.example_id, r.rubric_id, r.pos, a.anchor_id as bank_id, r.text, a.title as bank_text from rubric_items r join rubric_anchors a using (anchor_id)),
k as (select *, case when not {_malformed("text")} then trim(text) when not {_malformed("bank_text")} then trim(bank_text) end as good from s)
select example_id, bank_id, good as text from k where good is not null qualify row_number() over (partition by example_id, bank_id order by pos, rubric_id) = 1""")  # fmt: skip
def sane_rubrics(spark: SparkSession, where: str) -> DataFrame:
    """Rubrics that can be judged, one for each anchor of an example; the anchor's title stands in for malformed ones."""
    anchors = table(spark, where, "rubric_anchors").select("anchor_id", F.col("title").alias("bank_text"))
    s = table(spark, where, "rubric_items").join(anchors, "anchor_id").select("example_id", F.col("anchor_id").alias("bank_id"), F.struct("pos", "rubric_id").alias("pos"), "text", "bank_text")
    return R.sane(s, "example_id").select("example_id", "bank_id", "text")


@query("""with a as (select bank_id, unnest(aliases) as alias, generate_subscripts(aliases, 1) as pos from bank_entries), l as (select bank_id, arg_max(alias, pos) filter (where alias is not null) as t from a group by 1)
select bank_id, case when trim(t) <> '' then trim(t) else text end as text, case when trim(t) <> '' then text end as bank_text from bank_entries left join l using (bank_id)""")  # fmt: skip
def rewritten_bank(spark: SparkSession, where: str) -> DataFrame:
    """The bank with the last alias of each entry as its rewrite."""
    bank = table(spark, where, "bank_entries")
    replies = bank.select("bank_id", F.posexplode("aliases").alias("pos", "text")).where("text is not null")
    return R.rewritten(bank.select("bank_id", "text"), replies).select("bank_id", "text", "bank_text")


def _mined(pairs: DataFrame) -> DataFrame:
    """An offline miner: a rubric that names the first tokens which the better response has and the worse one lacks."""
    more = F.slice(F.array_except(T.tokens("positive"), T.tokens("negative")), 1, 4)
    return pairs.where(F.size(more) == 4).select("example_id", F.concat(F.lit("Mentions "), F.array_join(more, " ")).alias("text"))


@query(f"""with {DECIDED}, sup as (select record_idx from decided where side <> gold_side),
own as (select p.record_idx, p.example_id, p.chosen_response as positive, p.rejected_response as negative from preferences p join sup using (record_idx)),
hard as (select record_idx, arg_max(rejected_response, (n, o)) as negative from (select a.record_idx, b.rejected_response, b.record_idx as o, length(b.rejected_response) as n from own a join preferences b on a.example_id = b.example_id and a.record_idx <> b.record_idx where b.rejected_response is not null) group by 1),
pairs as (select example_id, positive, negative from own union all select example_id, positive, hard.negative from own join hard using (record_idx)),
tok as (select example_id, w, min(i) as i, id from (select example_id, id, unnest(l) as w, generate_subscripts(l, 1) as i, n from (select example_id, row_number() over () as id, regexp_extract_all(lower(coalesce(positive, '')), '[a-z0-9_]+') as l, {sql_tokens("negative")} as n from pairs))
  where length(w) > 1 and w not in ({", ".join(f"'{x}'" for x in T.STOPWORDS)}) and not list_contains(n, w) group by example_id, id, w),
first as (select example_id, id, string_agg(w, ' ' order by i) as t, count(*) as n from (select * from tok qualify row_number() over (partition by id order by i) <= 4) group by 1, 2),
fresh as (select distinct example_id, {SIG.replace("text", "'Mentions ' || t")} as signature from first where n = 4)
select example_id, count(*)::bigint as n_added from fresh f where not exists (select 1 from rubric_items r where r.example_id = f.example_id and {SIG.replace("text", "r.text")} = f.signature) group by 1""")  # fmt: skip
def expanded_candidates(spark: SparkSession, where: str) -> DataFrame:
    """Rubrics that wrongly decided pairs, and their longest other rejected response, add to an example's candidates."""
    prefs = table(spark, where, "preferences")
    support = _decided(spark, where).where("not correct").select("record_idx")
    examples = prefs.select("record_idx", "example_id", F.col("chosen_response").alias("positive"), F.col("rejected_response").alias("negative"))
    # The two longest of an example are enough: a record takes the longest that isn't its own.
    best = prefs.where("rejected_response is not null and example_id is not null").withColumn("o", F.struct(F.length("rejected_response"), "record_idx"))
    ranked = best.groupBy("example_id").agg(F.max_by(F.struct("record_idx", "rejected_response"), "o").alias("first"))
    second = best.join(ranked.select("example_id", F.col("first.record_idx").alias("f")), "example_id").where("record_idx <> f").groupBy("example_id").agg(F.max_by("rejected_response", "o").alias("second"))
    hard = examples.join(support, "record_idx", "left_semi").join(ranked, "example_id").join(second, "example_id", "left")
    hard = hard.select("record_idx", F.when(F.col("first.record_idx") == F.col("record_idx"), F.col("second")).otherwise(F.col("first.rejected_response")).alias("negative"))
    cache = table(spark, where, "rubric_items").where("text is not null").select("example_id", "text")
    return R.expand(cache, support, examples, hard, _mined).groupBy("example_id").agg(F.count("*").alias("n_added"))


@query(f"""with gone as (select distinct {SIG} as s from bank_entries where text is not null and observed_count <= 1 and {SIG} <> ''),
c as (select {sql_facet("facet")} as facet, {SIG} as s from rubric_items where text is not null)
select facet, count(*)::bigint as n, count(*) filter (where s in (select s from gone))::bigint as n_excluded from c where s <> '' group by 1""")  # fmt: skip
def excluded_candidates(spark: SparkSession, where: str) -> DataFrame:
    """Candidates by facet, and how many are excluded since an entry of theirs, met once at most, was removed from the bank."""
    removed = table(spark, where, "bank_entries").where("text is not null and observed_count <= 1").select("text")
    none = removed.select(F.lit("").alias("signature")).limit(0)
    gone = R.excluded(none, removed).withColumn("gone", F.lit(True))
    c = table(spark, where, "rubric_items").select(T.facet("facet").alias("facet"), T.signature("text").alias("signature")).where("signature <> ''")
    return c.join(gone, "signature", "left").groupBy("facet").agg(F.count("*").alias("n"), F.count_if("gone").alias("n_excluded"))


@query(f"""with c as (select rubric_id, text, {SIG} as signature from rubric_items where {SIG} <> ''), f as (select signature, arg_max(text, (-(case importance when 'critical' then 0 when 'major' then 1 when 'minor' then 2 else 3 end), length(text), -rubric_id)) as kept
  from (select rubric_id, text, {SIG} as signature, case when lower(trim(regexp_replace(importance, '\\s+', ' ', 'g'))) in ('critical', 'major', 'minor') then lower(trim(regexp_replace(importance, '\\s+', ' ', 'g'))) else 'major' end as importance from rubric_items) where signature <> '' group by 1)
select signature, text as alias, min(rubric_id) as first_id from c join f using (signature) where text <> kept group by 1, 2""")  # fmt: skip
def collapsed_aliases(spark: SparkSession, where: str) -> DataFrame:
    """The other wordings of each entry of the collapsed bank, one row each."""
    return B.aliases(table(spark, where, "rubric_items"))
