"""Queries on rubrics and the bank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import bank as B
from quillmark.operators import selection as S
from quillmark.plans.pairs import sql_facet, sql_importance, sql_tokens
from quillmark.plans.registry import query
from quillmark.session import durable, table

SIG = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
RANK = "(case importance when 'critical' then 0 when 'major' then 1 when 'minor' then 2 else 3 end)"


@query(f"""select sig_hash, min(doc_id) as doc_id, count(*)::bigint as n from (
  select doc_id, substr(sha256({SIG}), 1, 16) as sig_hash from documents where text is not null and {SIG} <> '') group by 1""")  # fmt: skip
def sig_dedup_documents(spark: SparkSession, where: str) -> DataFrame:
    d = table(spark, where, "documents").select("doc_id", T.signature("text").alias("s")).where("s <> ''")
    return d.groupBy(T.stable_hash("s").alias("sig_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"""select {sql_facet("facet")} as facet, {sql_importance("importance")} as importance, count(*)::bigint as n, count(distinct anchor_id)::bigint as n_anchors from rubric_items group by 1, 2""")
def facet_importance_counts(spark: SparkSession, where: str) -> DataFrame:
    r = table(spark, where, "rubric_items")
    return r.groupBy(T.facet("facet").alias("facet"), T.importance("importance").alias("importance")).agg(F.count("*").alias("n"), F.count_distinct("anchor_id").alias("n_anchors"))


def _issue_sql() -> str:
    """The issue of a text t as ``text.rubric_issue`` words it, over lists of words."""
    low, words = "lower(t)", "regexp_extract_all(lower(t), '[a-z]+(?:''[a-z]+)?')"
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    at = lambda i, names: f"coalesce({words}[{i}] in ({quoted(names)}), false)"
    asks = at("1", T.AUXILIARIES)
    determined = f"({asks}::int + {at(f'{asks}::int + 1', T.DETERMINERS)}::int)"
    subject = at(f"{determined} + 1", T.SUBJECTS)
    said = f"{words}[{determined} + {subject}::int + 1:]"
    has = lambda w: f"len(list_intersect({w}, [{quoted(T.PREDICATES)}])) > 0"
    only_the = f"({words}[1] = 'the' or {words}[1] not in ({quoted(T.DETERMINERS)}))"
    hangs = f"(len({said}) = 0 or coalesce(list_last({said}) in ({quoted(T.DANGLING)}), false))"
    count = lambda x: f"(length(t) - length(replace(t, '{x}', '')))"
    return f"""case when t = '' then 'empty_text' when {low} in ({quoted(T.FIELD_LABELS)}) then 'field_label_only'
when not {asks} and {subject} and {only_the} and len({said}) = 0 and regexp_matches({low}, '^[a-z ]+$') then 'generic_subject_only'
when {asks} and len({said}) = 0 and right(t, 1) = '?' then 'incomplete_question_stem'
when len({words}) = 0 then 'missing_word_tokens' when len({words}) = 1 then 'single_token_fragment'
when right(t, 1) in ('(', '[', '{{', ':', '/', '-', '"', '''') then 'dangling_terminal'
when {count("(")} > {count(")")} or {count("[")} > {count("]")} or {count("{")} > {count("}")} then 'unbalanced_brackets'
when list_last({words}) in ({quoted(T.DANGLING)}) then 'dangling_suffix'
when case when right(t, 1) = '?' then {asks} and {hangs} when {words}[1] = 'no' then false
  else (len({words}) <= 3 and {at("1", T.DETERMINERS)} and not {has(words)}) or (not {asks} and {subject} and {only_the} and ({hangs} or (len({said}) <= 2 and not {has(said)}))) end
  then 'bare_subject_fragment' else 'none' end"""


@query(f"""select issue, count(*)::bigint as n, min(rubric_id) as first_id from (select rubric_id, {_issue_sql()} as issue from (
  select rubric_id, regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\\s\\x{{00A0}}\\x{{3000}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{1680}}\\x{{2028}}\\x{{2029}}\\x{{0085}}\\x{{000B}}]+', ' ', 'g')), '\\s+([?!.,;:])', '\\1', 'g') as t from rubric_items)) group by 1""")  # fmt: skip
def rubric_quality_issues(spark: SparkSession, where: str) -> DataFrame:
    issue = F.coalesce(T.rubric_issue("text"), F.lit("none")).alias("issue")
    return table(spark, where, "rubric_items").groupBy(issue).agg(F.count("*").alias("n"), F.min("rubric_id").alias("first_id"))


COLLAPSED = f"""c as (select signature, count(*) as observed_count,
  arg_max(text, (-{RANK}, length(text), -rubric_id)) as text, arg_max(importance, -{RANK}) as importance, arg_min(facet, rubric_id) as facet, arg_min(source, rubric_id) as source,
  arg_min(grounding, rubric_id) filter (where trim(grounding) <> '') as grounding, min(rubric_id) as first_id
  from (select rubric_id, text, {SIG} as signature, {sql_facet("facet")} as facet, {sql_importance("importance")} as importance, source, grounding from rubric_items) where signature <> '' group by 1)"""


@query(f"with {COLLAPSED} select signature, observed_count::bigint as observed_count, text, importance, facet, source, grounding, first_id from c")
def exact_collapse_bank(spark: SparkSession, where: str) -> DataFrame:
    return B.collapse(table(spark, where, "rubric_items"))


@query(f"""with {COLLAPSED} select (row_number() over (order by observed_count desc, {RANK}, facet, text) - 1)::int as bank_id, signature, observed_count::bigint as observed_count from c
qualify row_number() over (order by observed_count desc, {RANK}, facet, text) <= 1024""")  # fmt: skip
def largest_bank(spark: SparkSession, where: str) -> DataFrame:
    return B.largest(B.collapse(table(spark, where, "rubric_items"))).select("bank_id", "signature", "observed_count")


def _bank(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "bank_entries").select(F.col("bank_id").cast("long").alias("id"), "text", "facet")


def _candidates(spark: SparkSession, where: str) -> DataFrame:
    """The aliases of the bank, as candidates of the entry that proposed them."""
    b = table(spark, where, "bank_entries").select("bank_id", "facet", F.posexplode("aliases").alias("pos", "text")).where("text is not null")
    return b.select((F.col("bank_id").cast("long") * 1000 + F.col("pos")).alias("id"), "text", "facet", F.col("bank_id").cast("long").alias("owner"), "pos")


SETS = f"""ra as (select bank_id::bigint as owner, facet, unnest(aliases) as text, generate_subscripts(aliases, 1) - 1 as pos from bank_entries),
r as (select owner * 1000 + pos as id, owner, pos, {sql_tokens("text")} as s, {SIG} as sig, {sql_facet("facet")} as f from ra where text is not null),
b as (select bank_id::bigint as id, {sql_tokens("text")} as s, {SIG} as sig, {sql_facet("facet")} as f from bank_entries where text is not null)"""


def _overlaps(left: str, right: str) -> str:
    return f"""(select x.id as a, y.id as b, count(*) as n from (select id, unnest(s) as w from {left}) x join (select id, unnest(s) as w from {right}) y on x.w = y.w group by 1, 2)"""


MATCHED = f"""{SETS}, o as (select a, b, n::double / (len(r.s) + len(b.s) - n) as j, r.f = b.f as same, r.sig = b.sig as exact from {_overlaps("r", "b")} o join r on r.id = a join b on b.id = o.b),
m as (select a, b, case when exact then 1.0 else j end + case when same then 0.05 else 0 end as score from o where j >= 0.83 - 1e-9),
best as (select a as id, arg_max(b, (score, -b)) as bank_id, least(1.0, max(score)) as score from m where score >= 0.88 - 1e-9 group by 1)"""


@query(f"with {MATCHED} select id, bank_id, round(score, 6) as score from best")
def bank_matches(spark: SparkSession, where: str) -> DataFrame:
    m = B.matches(_candidates(spark, where), _bank(spark, where))
    return m.select("id", "bank_id", F.round("score", 6).alias("score"))


@query(f"""with {MATCHED} select owner, string_agg(bank_id::varchar, ',' order by first_pos, bank_id) as bank_ids, count(*)::bigint as n from (
  select owner, bank_id, min(pos) as first_pos from best join r using (id) group by 1, 2) group by 1""")  # fmt: skip
def matched_bank_ids(spark: SparkSession, where: str) -> DataFrame:
    c = _candidates(spark, where)
    m = B.matches(c, _bank(spark, where)).join(c.select("id", "owner", "pos"), "id")
    first = m.groupBy("owner", "bank_id").agg(F.min("pos").alias("p"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "bank_id"))), lambda s: s["bank_id"].cast("string")), ",")
    return first.groupBy("owner").agg(ids.alias("bank_ids"), F.count("*").alias("n"))


@query(f"""with {SETS}, o as (select a, o.b, n::double / (len(x.s) + len(y.s) - n) as j from {_overlaps("b", "b")} o join b x on x.id = a join b y on y.id = o.b where a < o.b)
select a as bank_a, b as bank_b, round((j - 0.92) / 0.08, 6) as weight from o where j >= 0.92 - 1e-9""")  # fmt: skip
def bank_diversity_edges(spark: SparkSession, where: str) -> DataFrame:
    bank = _bank(spark, where)
    e = B.similar_pairs(bank, bank, 0.92).where("a < b")
    return e.select(F.col("a").alias("bank_a"), F.col("b").alias("bank_b"), F.round((F.col("overlap") - 0.92) / 0.08, 6).alias("weight"))


def _leaders_sql(nodes: str, least: float) -> str:
    """Greedy leaders one by one: lt(id, i) are nodes in their order, lx(a, b, score) links from later to earlier ones, ll(i) the leaders."""
    return f"""lt as (select id, row_number() over (order by {nodes}) as i from ranked),
lw as (select b.id, lt.i, b.s from b join lt using (id)),
lo as (select x.i as a, y.i as b, count(*) as n from (select i, unnest(s) as w from lw) x join (select i, unnest(s) as w from lw) y on x.w = y.w and x.i > y.i group by 1, 2),
lx as (select o.a, o.b, o.n::double / (len(p.s) + len(q.s) - o.n) as score from lo o join lw p on p.i = o.a join lw q on q.i = o.b where o.n::double / (len(p.s) + len(q.s) - o.n) >= {least} - 1e-9),
le as (select a, list(b) as before from lx group by 1),
lg(i, leaders) as (select 0::bigint, []::bigint[] union all select lt.i, case when list_has_any(lg.leaders, coalesce(le.before, [])) then lg.leaders else list_append(lg.leaders, lt.i) end from lg join lt on lt.i = lg.i + 1 left join le on le.a = lt.i),
ll as (select unnest(leaders) as i from lg where i = (select max(i) from lt))"""


@query(f"""with recursive {SETS}, ranked as (select bank_id::bigint as id, coalesce(observed_count, 0) as c from bank_entries), {_leaders_sql("c desc, id", 0.6)},
f as (select lx.a, arg_max(lt.id, (lx.score, -lt.id)) as leader_id from lx join ll on ll.i = lx.b join lt on lt.i = lx.b where lx.a not in (select i from ll) group by 1)
select lt.id as bank_id, coalesce(f.leader_id, lt.id) as leader_id from lt left join f on f.a = lt.i""")  # fmt: skip
def bank_leader_clusters(spark: SparkSession, where: str) -> DataFrame:
    """Greedy leaders of the bank in the order of observed count and id, at an overlap of 0.6."""
    bank = table(spark, where, "bank_entries")
    nodes = bank.select(F.col("bank_id").cast("long").alias("id"), "text", F.struct(-F.coalesce("observed_count", F.lit(0)), F.col("bank_id").cast("long")).alias("rank"))
    return B.leaders_of_texts(nodes, 0.6).withColumnsRenamed({"id": "bank_id"})


PRUNE = """p as (select bank_id, observed_count, coalesce(support_count, 0) as support_count, coalesce(activation_count, 0) as activation_count from bank_entries),
t as (select sum(activation_count)::double as total from p),
w as (select p.*, case when total > 0 then activation_count / total else 0 end as rate, ln(1 + exp(activation_count / 10.0 - 3)) / 10 as weight from p, t)"""


def _weighted(spark: SparkSession, where: str) -> DataFrame:
    p = table(spark, where, "bank_entries").select("bank_id", "observed_count", F.coalesce("support_count", F.lit(0).cast("long")).alias("support_count"), F.coalesce("activation_count", F.lit(0).cast("long")).alias("activation_count"))
    total = p.agg(F.sum("activation_count").cast("double").alias("total")).first()["total"] or 0.0
    rate = F.col("activation_count") / F.lit(total) if total else F.lit(0.0)
    return p.withColumns({"rate": rate, "weight": F.log(1 + F.exp(F.col("activation_count") / 10.0 - 3)) / 10})


@query(f"""with {PRUNE} select bank_id, round(4.0 * weight + 2.0 * rate + 0.2 * support_count + 0.1 * observed_count, 6) as score,
coalesce(weight >= 0.08 or rate >= 0.01 or support_count > 0, false) as keep from w""")  # fmt: skip
def prune_filter(spark: SparkSession, where: str) -> DataFrame:
    return B.prune_filter(_weighted(spark, where)).select("bank_id", F.round("score", 6).alias("score"), "keep")


@query(f"""with recursive {SETS}, {PRUNE}, ranked as (select bank_id::bigint as id, 4.0 * weight + 2.0 * rate + 0.2 * support_count + 0.1 * observed_count as score from w where coalesce(weight >= 0.08 or rate >= 0.01 or support_count > 0, false)),
{_leaders_sql("score desc, id", 0.92)} select lt.id as bank_id from lt join ll using (i)""")  # fmt: skip
def pruned_bank(spark: SparkSession, where: str) -> DataFrame:
    """Entries that the filter keeps and that are no near copy (overlap 0.92) of a better-scored one, in new order."""
    kept = B.top_up(B.prune_filter(_weighted(spark, where)), 16).where("keep")
    texts = table(spark, where, "bank_entries").select("bank_id", "text").join(kept.select("bank_id"), "bank_id", "left_semi").select(F.col("bank_id").cast("long").alias("id"), "text")
    edges = B.similar_pairs(texts, texts, 0.92).where("a < b").select("a", "b", F.col("overlap").alias("score"))
    nodes = kept.select(F.col("bank_id").cast("long").alias("id"), F.struct(-F.col("score"), F.col("bank_id").cast("long")).alias("rank"))
    return B.leaders(nodes, edges).where("id = leader_id").select(F.col("id").alias("bank_id"))


@query(f"""with x as (select {sql_facet("facet")} as facet, {SIG} as s from bank_entries where text is not null),
y as (select rubric_id as id, {sql_facet("facet")} as facet, {SIG} as s from rubric_items where text is not null)
select facet, count(distinct s)::bigint as n_new, min(id) as first_id from y where s <> '' and not exists (select 1 from x where x.facet = y.facet and x.s = y.s) group by 1""")  # fmt: skip
def new_candidates_by_facet(spark: SparkSession, where: str) -> DataFrame:
    bank = table(spark, where, "bank_entries").select(T.facet("facet").alias("facet"), "text")
    items = table(spark, where, "rubric_items").select(F.col("rubric_id").alias("id"), T.facet("facet").alias("facet"), "text")
    return B.new_candidates(bank, items, "facet").groupBy("facet").agg(F.count("*").alias("n_new"), F.min("id").alias("first_id"))


def _worth(*chosen: str) -> str:
    sim = "greatest(" + ", ".join(f"case when len(p.t) = 0 or len({c}.t) = 0 then 0 else len(list_intersect(p.t, {c}.t))::double / len(list_distinct(list_concat(p.t, {c}.t))) end" for c in chosen) + ", 0)"
    return f"(p.weight - 0.35 * {sim} - ({sim} >= 0.92)::int)"


@query(f"""with p0 as (select example_id, rubric_id, {sql_tokens("text")} as t, {sql_facet("facet")} as facet, case {sql_importance("importance")} when 'critical' then 3.0::double when 'minor' then 1.0::double else 2.0::double end as weight from rubric_items where text is not null),
p as (select *, row_number() over (partition by example_id order by weight desc, rubric_id) as i from p0 qualify i <= 18), a as (select * from p where i = 1),
b as (select p.* from p join a using (example_id) where p.i <> a.i qualify row_number() over (partition by example_id order by {_worth("a")} desc, p.i) = 1),
c as (select p.* from p join a using (example_id) join b using (example_id) where p.i not in (a.i, b.i)
  qualify row_number() over (partition by example_id order by (p.facet = a.facet and p.facet = b.facet)::int, {_worth("a", "b")} desc, p.i) = 1)
select example_id, rubric_id, 1 as place from a union all select example_id, rubric_id, 2 from b union all select example_id, rubric_id, 3 from c""")  # fmt: skip
def diverse_rubrics(spark: SparkSession, where: str) -> DataFrame:
    r = table(spark, where, "rubric_items")
    pool = r.where("text is not null").select("example_id", "rubric_id", "text", T.facet("facet").alias("facet"), T.importance_weight(T.importance("importance")).alias("weight"))
    return S.diverse(pool, k=3)


_SET = "list_filter(list_distinct(string_split({}, ' ')), lambda x: x <> '')"


@query(f"""with bank as (select bank_id::bigint as bank_id, {_SET.format(SIG)} as s from bank_entries where text is not null), b as (select * from bank where len(s) > 0),
p as (select record_idx, example_id, {_SET.format(SIG.replace("text", "prompt_text"))} as s from preferences where prompt_text is not null),
m as (select distinct p.record_idx, e.bank_id::bigint as bank_id, r.pos from p join rubric_items r using (example_id) join bank_entries e on {SIG.replace("text", "r.text")} = {SIG.replace("text", "e.text")} where {SIG.replace("text", "e.text")} <> ''),
m1 as (select record_idx, bank_id, min(pos) as pos from m group by 1, 2), m2 as (select record_idx, bank_id, row_number() over (partition by record_idx order by pos, bank_id) as rn from m1),
rest as (select * from p where record_idx not in (select record_idx from m1)),
o as (select record_idx, bank_id, count(*) as n from (select record_idx, unnest(s) as w from rest) x join (select bank_id, unnest(s) as w from b) y using (w) group by 1, 2),
t as (select record_idx, bank_id, row_number() over (partition by record_idx order by n::double / len(s) desc, bank_id desc) as rn from o join b using (bank_id)),
h as (select bank_id, row_number() over (order by bank_id) as rn from bank order by bank_id limit 4)
select record_idx, bank_id, rn::int as rn from m2 where rn <= 4 union all select record_idx, bank_id, rn::int from t where rn <= 4
union all select record_idx, bank_id, rn::int from (select record_idx from rest where record_idx not in (select record_idx from o)), h""")  # fmt: skip
def prompt_bank_topk(spark: SparkSession, where: str) -> DataFrame:
    """The entries that a prompt is scored with: those its example's rubrics equal, else the four of whose words it holds most, else the first four."""
    bank = table(spark, where, "bank_entries").select(F.col("bank_id").cast("long").alias("bank_id"), "text")
    prompts = table(spark, where, "preferences").where("prompt_text is not null").select(F.col("record_idx").alias("id"), "example_id", F.col("prompt_text").alias("text"))
    by_text = bank.select("bank_id", T.signature("text").alias("s")).where("s <> ''")
    proposed = table(spark, where, "rubric_items").select("example_id", "pos", T.signature("text").alias("s")).join(by_text, "s").groupBy("example_id", "bank_id").agg(F.min("pos").alias("pos"))
    matched = prompts.select("id", "example_id").join(proposed, "example_id").select("id", "bank_id", "pos")
    return B.candidate_ids(prompts.select("id", "text"), matched, bank).withColumnRenamed("id", "record_idx")


@query()
def alias_lookup(spark: SparkSession, where: str) -> DataFrame:
    """The best entry of the bank for each alias, by tokens or characters."""
    c = _candidates(spark, where).select("id", "text", "facet")
    return B.best_match(c, _bank(spark, where)).select("id", "bank_id", F.round("score", 6).alias("score"))


@query()
def proposal_clusters(spark: SparkSession, where: str) -> DataFrame:
    """Greedy leaders of the collapsed proposals in the order of count, importance, facet and text, by tokens or characters at 0.88."""
    c = durable(B.collapse(table(spark, where, "rubric_items")).select(F.col("first_id").alias("id"), "text", "facet", "importance", "observed_count"))
    nodes = c.select("id", F.struct(-F.col("observed_count"), T.importance_rank("importance"), "facet", "text", "id").alias("rank"))
    edges = B.lookup(c, c, equal=False).where("id <> bank_id").select(F.least("id", "bank_id").alias("a"), F.greatest("id", "bank_id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    return B.leaders(nodes, edges).withColumnsRenamed({"id": "rubric_id"})


@query()
def alias_similarity(spark: SparkSession, where: str) -> DataFrame:
    """How like each alias is to its entry's text: the greater of token overlap and character ratio."""
    b = table(spark, where, "bank_entries").where("text is not null").select("bank_id", "text", F.explode("aliases").alias("alias")).where("alias is not null")
    return b.select("bank_id", "alias", F.round(T.rubric_similarity("text", "alias"), 6).alias("similarity"))
