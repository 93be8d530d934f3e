"""Queries on selection, metrics, votes, stages and training."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import metrics as M
from quillmark.operators import pairs as P
from quillmark.operators import selection as S
from quillmark.operators import stages as G
from quillmark.operators import worklist as K
from quillmark.plans.pairs import COMPARED, DECIDED, LANG, _compared, _decided, language, sql_tokens
from quillmark.plans.registry import query
from quillmark.session import table
from quillmark.sources.records import official_domain

LOGITS = "l as (select vec_id, generate_subscripts(embedding, 1) - 1 as pos, 20.0 * unnest(embedding)::double as z from embeddings)"
SPARSE = f"""{LOGITS}, k as (select *, row_number() over w as k, sum(z) over (w rows unbounded preceding) - 1.0 as c from l window w as (partition by vec_id order by z desc, pos)),
n as (select *, max(case when z * k > c then k end) over (partition by vec_id) as n from k),
t as (select *, max(case when k = n then c / k end) over (partition by vec_id) as tau from n),
alpha as (select vec_id, pos, greatest(z - tau, 0.0) as alpha from t)"""


def _alpha(spark: SparkSession, where: str) -> DataFrame:
    logits = table(spark, where, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e")).select("vec_id", "pos", (F.lit(20.0) * F.col("e").cast("double")).alias("z"))
    return S.sparsemax(logits, "vec_id", "pos", "z")


@query(f"with {SPARSE} select vec_id, pos::int as pos, round(alpha, 6) as alpha from alpha where alpha > 0")
def sparsemax_embeddings(spark: SparkSession, where: str) -> DataFrame:
    return _alpha(spark, where).where("alpha > 0").select("vec_id", "pos", F.round("alpha", 6).alias("alpha"))


@query(f"""with {SPARSE} select vec_id, pos::int as pos, rn::int as rn from (
  select vec_id, pos, row_number() over (partition by vec_id order by alpha * (1 + pos % 7) desc, pos) as rn from alpha) where rn <= 6""")  # fmt: skip
def selected_topk(spark: SparkSession, where: str) -> DataFrame:
    """The six dimensions of greatest activation times weight for each vector."""
    return S.top(_alpha(spark, where), "vec_id", F.col("alpha") * (1 + F.col("pos") % 7), "pos", 6).select("vec_id", "pos", "rn")


@query(f"""with {SPARSE} select pos::int as pos, count(*) filter (where alpha > 0)::bigint as activations, round(avg((alpha > 0)::int), 6) as rate, round(sum(alpha), 4) as mass from alpha group by 1""")
def bank_usage(spark: SparkSession, where: str) -> DataFrame:
    a = _alpha(spark, where).groupBy("pos")
    return a.agg(F.count_if(F.col("alpha") > 0).alias("activations"), F.round(F.avg((F.col("alpha") > 0).cast("int")), 6).alias("rate"), F.round(F.sum("alpha"), 4).alias("mass"))


@query("""with w as (select doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') as w from documents where text is not null),
terms as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from w union all
  select doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) from w where len(w) > 1) group by 1, 2),
v as (select term, sum(tf) as total, count(*) as df from terms group by 1 order by total desc, term limit 4096),
n as (select count(*) as n from documents where text is not null),
raw as (select doc_id, term, tf * (ln((1.0 + n) / (1 + df)) + 1) as w from terms join v using (term), n),
norm as (select doc_id, sqrt(sum(w * w)) as norm from raw group by 1)
select doc_id, term, weight, rn::int as rn from (select doc_id, term, round(w / norm, 6) as weight, row_number() over (partition by doc_id order by round(w / norm, 9) desc, term) as rn from raw join norm using (doc_id)) where rn <= 3""")  # fmt: skip
def tfidf_topk(spark: SparkSession, where: str) -> DataFrame:
    docs = table(spark, where, "documents").select(F.col("doc_id").alias("id"), "text")
    best = S.top(S.tfidf(docs), "id", F.round("weight", 9), "term", 3)
    return best.select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"), "rn")


_HARD = """hard as (select record_idx, case gold_side when 'B' then 0.0 - margin else margin end as gold_margin, side = gold_side as correct from decided)"""


@query(f"""with {DECIDED}, {_HARD} select record_idx, round(gold_margin, 6) as gold_margin, correct from hard
where gold_margin <= 0.1 or not correct order by gold_margin asc nulls first, record_idx limit 1024""")  # fmt: skip
def support_pairs(spark: SparkSession, where: str) -> DataFrame:
    return S.support_pairs(_decided(spark, where), 0.1, 1024).select("record_idx", F.round("gold_margin", 6).alias("gold_margin"), "correct")


@query("""with r as (select record_idx, sha256(concat_ws(':', '13', record_idx::varchar)) as h, count(*) over () as n from preferences)
select record_idx, row_number() over (order by h, record_idx) <= greatest(1, round_even(n * 0.05, 0)) as is_dev from r""")  # fmt: skip
def dev_split(spark: SparkSession, where: str) -> DataFrame:
    return S.seeded_split(table(spark, where, "preferences").select("record_idx"), "record_idx", 0.05, 13)


@query(f"""with p as (select example_id, record_idx, {sql_tokens("prompt_text")} as t, chosen_response, rejected_response from preferences where prompt_text is not null),
s as (select example_id, record_idx, case when len(t) = 0 then 0.0::double else len(list_intersect(t, {sql_tokens("chosen_response")}))::double / len(t) end as c,
  case when len(t) = 0 then 0.0::double else len(list_intersect(t, {sql_tokens("rejected_response")}))::double / len(t) end as r from p),
f as (select example_id, arg_min(c, record_idx) as c from s group by 1),
m as (select example_id, f.c - s.r as margin from s join f using (example_id)),
i as (select example_id, bool_and(margin > 0) as correct, count(*) as pairs, count(*) filter (where margin > 0) as won, min(margin) as low from m group by 1)
select count(*)::bigint as items, count(*) filter (where correct)::bigint as correct, sum(pairs)::bigint as pair_total, sum(won)::bigint as pair_correct,
round(avg(correct::int), 6) as accuracy, round(sum(won)::double / sum(pairs), 6) as pair_accuracy, round(avg(low), 6) as avg_min_margin from i""")  # fmt: skip
def best_of_n_summary(spark: SparkSession, where: str) -> DataFrame:
    """The first chosen response of each example against all its rejected ones, by share of the prompt's tokens."""
    p = table(spark, where, "preferences").where("prompt_text is not null").withColumn("t", T.tokens("prompt_text"))
    s = p.select("example_id", "record_idx", P.share_of("t", T.tokens("chosen_response")).alias("c"), P.share_of("t", T.tokens("rejected_response")).alias("rejected"))
    first = s.groupBy("example_id").agg(F.min_by("c", "record_idx").alias("chosen"))
    items = M.best_of_n(s.join(first, "example_id").select("example_id", "chosen", F.array("rejected").alias("rejected")), "example_id")
    return items.agg(
        F.count("*").alias("items"), F.count_if("correct").alias("correct"), F.sum("pairs").alias("pair_total"), F.sum("pairs_won").alias("pair_correct"),
        F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.sum("pairs_won") / F.sum("pairs"), 6).alias("pair_accuracy"), F.round(F.avg("min_margin"), 6).alias("avg_min_margin"),
    )


#: The responses of the pairs with their share of the prompt's tokens.
RATED = f"""rated as (select record_idx, example_id, coalesce(nullif(lower(trim(regexp_replace(domain, '\\s+', ' ', 'g'))), ''), 'unknown') as domain, {LANG} as language, split,
  case when len(t) = 0 then 0.0::double else len(list_intersect(t, {sql_tokens("chosen_response")}))::double / len(t) end as c,
  case when len(t) = 0 then 0.0::double else len(list_intersect(t, {sql_tokens("rejected_response")}))::double / len(t) end as r
  from (select *, {sql_tokens("prompt_text")} as t from preferences where prompt_text is not null))"""


def _rated(spark: SparkSession, where: str) -> DataFrame:
    p = table(spark, where, "preferences").where("prompt_text is not null").withColumn("t", T.tokens("prompt_text"))
    return p.select("record_idx", "example_id", T.domain("domain").alias("domain"), language().alias("language"), "split", P.share_of("t", T.tokens("chosen_response")).alias("c"), P.share_of("t", T.tokens("rejected_response")).alias("r"))


@query(f"""with {RATED}, v as (select example_id, record_idx * 2 as pos, c as value from rated union all select example_id, record_idx * 2 + 1, r from rated)
select a.example_id, a.pos, case when n > 1 then round((n * value - total) / (n - 1), 6) else 0 end as score from v a join (select example_id, sum(value) as total, count(*) as n from v group by 1) using (example_id)""")  # fmt: skip
def round_robin_scores(spark: SparkSession, where: str) -> DataFrame:
    """Every response of an example against all others of it, by share of the prompt's tokens."""
    two = F.explode(F.array(F.struct((F.col("record_idx") * 2).alias("pos"), F.col("c").alias("value")), F.struct((F.col("record_idx") * 2 + 1).alias("pos"), F.col("r").alias("value")))).alias("v")
    v = _rated(spark, where).where("example_id is not null").select("example_id", two).select("example_id", "v.*")
    return M.round_robin(v, "example_id").select("example_id", "pos", F.round("score", 6).alias("score"))


TIES = f"""{RATED}, g as (select <keys>domain as grp, record_idx % 2 as half, min(c) as low, max(c) as high, max(r) as worst, count(c) as n from rated group by all),
s as (select <keys>grp, half, low > worst as accurate, case when n > 1 then high - low end as spread, low - worst as separation from g),
j as (select <t_keys>r.accurate as ra, t.accurate as ta, t.separation as ts, least(r.separation, t.separation) as near, t.spread as sp from s t join s r on t.grp = r.grp <same>and t.half = 1 and r.half = 0)"""


def _ties(keys: str, t_keys: str, same: str) -> str:
    return TIES.replace("<keys>", keys).replace("<t_keys>", t_keys).replace("<same>", same)


BLEND = """0.30 * coalesce(avg(coalesce(ta, false)::int), 0) + 0.30 * coalesce(avg(coalesce(ra, false)::int), 0) + 0.20 * coalesce(avg(coalesce(ts > sp, false)::int), 0)
+ 0.20 * coalesce(avg(coalesce(near > sp, false)::int), 0) + 0.01 * coalesce(avg(near - sp), 0)"""


def _halves(rated: DataFrame, *keys: str) -> DataFrame:
    """Reference and tied halves of each domain: all chosen responses are the correct ones, all rejected the incorrect."""
    g = rated.groupBy(*keys, F.col("domain").alias("grp"), (F.col("record_idx") % 2).alias("half")).agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("r").alias("worst"), F.count("c").alias("n"))
    s = g.select(*keys, "grp", "half", *M.ties_from(F.col("low"), F.col("high"), F.col("worst"), F.col("n")))
    tied = s.where("half = 1").select(*keys, "grp", F.col("accurate").alias("tied_accurate"), F.col("separation").alias("tied_separation"), "spread")
    ref = s.where("half = 0").select(*keys, "grp", F.col("accurate").alias("ref_accurate"), F.col("separation").alias("ref_separation"))
    return tied.join(ref, [*keys, "grp"])


@query(f"with {_ties('', '', '')} select count(*)::bigint as n_groups, round({BLEND}, 6) as score from j")
def ties_score(spark: SparkSession, where: str) -> DataFrame:
    """Reference and tied halves of the domains, their spreads and separations, and the blended score."""
    return M.ties_score(_halves(_rated(spark, where))).select("n_groups", F.round("score", 6).alias("score"))


@query(f"""with {_ties("language, ", "t.language, ", "and t.language = r.language ")}, t as (select language as subset, {BLEND} as x from j where language = 'fr' group by 1),
a as (select language as subset, avg((c > r)::int) as x from rated where language <> 'fr' group by 1)
select round(avg(x), 6) as score, count(*)::bigint as n_subsets from (select * from t union all select * from a)""")  # fmt: skip
def subsets_score(spark: SparkSession, where: str) -> DataFrame:
    """The mean over languages as subsets; French stands for the subset that is scored by its ties."""
    rated = _rated(spark, where)
    ties = M.ties_score(_halves(rated.where("language = 'fr'"))).where("n_groups > 0").select(F.lit("fr").alias("subset"), "score")
    rest = rated.where("language <> 'fr'").groupBy(F.col("language").alias("subset")).agg(F.avg((F.col("c") > F.col("r")).cast("int")).alias("accuracy"))
    return M.mean_of_subsets(rest, ties).select(F.round("score", 6).alias("score"), "n_subsets")


# Three records of a domain and split make an item: three chosen responses, as rows, against three rejected ones.
CELLS = f"""{RATED}, n as (select *, row_number() over (partition by domain, split order by record_idx) - 1 as i from rated where split is not null),
k as (select a.domain, a.split || ':' || (a.i // 3)::varchar as item, a.i % 3 as row, b.i % 3 as col, (a.c > b.r)::int::double as win from n a join n b on a.domain = b.domain and a.split = b.split and a.i // 3 = b.i // 3),
cells as (select * from k where (domain, item) in (select (domain, item) from k group by domain, item having count(*) = 9))"""


def _cells(spark: SparkSession, where: str) -> DataFrame:
    n = _rated(spark, where).where("split is not null").withColumn("i", F.row_number().over(W.partitionBy("domain", "split").orderBy("record_idx")) - 1)
    triple = n.groupBy("domain", "split", F.floor(F.col("i") / 3).alias("at")).agg(F.array_sort(F.collect_list(F.struct("i", "c", "r"))).alias("t")).where(F.size("t") == 3)
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), (F.col("t")[a]["c"] > F.col("t")[b]["r"]).cast("double").alias("win")) for a in range(3) for b in range(3)))).alias("g")
    return triple.select("domain", F.concat_ws(":", "split", "at").alias("item"), grid).select("domain", "item", "g.*")


_DIFFICULTY = "round(avg(win) filter (where row > col), 6) as easy, round(avg(win) filter (where row = col), 6) as normal, round(avg(win) filter (where row < col), 6) as hard, round(avg(win), 6) as all"


@query(f"with {CELLS} select domain, {_DIFFICULTY}, count(*)::bigint as n_cells from cells group by 1")
def matrix_3x3_difficulty(spark: SparkSession, where: str) -> DataFrame:
    m = M.matrix(_cells(spark, where), "domain")
    return m.select("domain", *(F.round(c, 6).alias(c) for c in ("easy", "normal", "hard", "all")), "n_cells")


@query(f"""with {CELLS}, i as (select domain, item, bool_and(win > 0.5) as won, count(*) as n, sum(win) as w from cells group by 1, 2)
select domain, count(*)::bigint as n_items, round(avg(won::int), 6) as strict_accuracy, sum(n)::bigint as pair_total, sum(w) as pair_correct from i group by 1""")  # fmt: skip
def strict_items(spark: SparkSession, where: str) -> DataFrame:
    return M.strict(_cells(spark, where), "domain").withColumn("strict_accuracy", F.round("strict_accuracy", 6))


@query(f"""with {CELLS}, d as (select case domain when 'chat' then 'Chat' when 'code' then 'Code' when 'math' then 'Math' when 'safety-refuse' then 'Safety' when 'safety-response' then 'Safety' else 'Other' end as domain, row, col, win from cells),
m as (select domain, avg(win) filter (where row > col) as easy, avg(win) filter (where row = col) as normal, avg(win) filter (where row < col) as hard, avg(win) as al from d where domain <> 'Other' group by 1)
select round(avg(al), 6) as score, round(avg(easy), 6) as easy, round(avg(normal), 6) as normal, round(avg(hard), 6) as hard, count(*)::bigint as n_domains from m""")  # fmt: skip
def domains_score(spark: SparkSession, where: str) -> DataFrame:
    """The equal-weight mean over the official domains that the items cover, and the same by difficulty."""
    by = M.matrix(_cells(spark, where).withColumn("domain", official_domain("domain")), "domain")
    return M.macro(by).select(*(F.round(c, 6).alias(c) for c in ("score", "easy", "normal", "hard")), "n_domains")


# Raw domains of the published benchmark with their coarse domain and number of examples.
RAW_DOMAINS = (
    ("human-preference", "CHAT", 235), ("general", "CHAT", 108), ("Factuality", "CHAT", 44), ("Focus", "CHAT", 22), ("helpful", "CHAT", 13), ("code", "CODE", 258), ("mbpp", "CODE", 13), ("stem", "STEM", 167),
    ("math", "STEM", 71), ("Math", "STEM", 5), ("mmlu-pro", "STEM", 5), ("gpqa", "STEM", 2), ("ifeval", "IF", 101), ("PreciseIF", "IF", 23), ("harmlessness", "SAFETY", 45), ("Safety", "SAFETY", 35),
)


@query(f"""with {DECIDED}, w(domain, coarse, n) as (values {", ".join(f"('{d}', '{c}', {n})" for d, c, n in RAW_DOMAINS)})
select coalesce(coarse, 'OTHER') as coarse, count(*)::bigint as n_pairs, count(distinct decided.domain)::bigint as n_domains, round(avg((side = gold_side)::int), 6) as accuracy from decided left join w using (domain) group by 1""")  # fmt: skip
def coarse_domains(spark: SparkSession, where: str) -> DataFrame:
    """Accuracy by coarse domain; domains that the benchmark lacks are OTHER."""
    w = spark.createDataFrame(RAW_DOMAINS, "domain string, coarse string, n int").select("domain", "coarse")
    d = _decided(spark, where).join(F.broadcast(w), "domain", "left").groupBy(F.coalesce("coarse", F.lit("OTHER")).alias("coarse"))
    return d.agg(F.count("*").alias("n_pairs"), F.count_distinct("domain").alias("n_domains"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"))


# Examples of each coarse domain in the published benchmark.
DOMAINS = (("chat", "CHAT", 422), ("code", "CODE", 271), ("stem", "STEM", 250), ("instruction", "IF", 124), ("safety", "SAFETY", 80))


@query(f"""with {DECIDED}, a as (select coalesce(domain, 'unknown') as domain, avg((side = gold_side)::int) as accuracy from decided group by 1),
w(domain, section, weight) as (values {", ".join(f"('{d}', '{'Reasoning' if s in ('CODE', 'STEM') else 'General'}', {n})" for d, s, n in DOMAINS)})
select section, round(sum(weight * accuracy) / sum(weight), 6) as score, count(*)::bigint as n_subsets from a join w using (domain) group by 1""")  # fmt: skip
def section_scores(spark: SparkSession, where: str) -> DataFrame:
    return _sections(spark, where).select("section", F.round("score", 6).alias("score"), "n_subsets")


def _sections(spark: SparkSession, where: str) -> DataFrame:
    a = _decided(spark, where).groupBy(T.domain("domain").alias("domain")).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"))
    w = spark.createDataFrame([(d, "Reasoning" if s in ("CODE", "STEM") else "General", n) for d, s, n in DOMAINS], "domain string, section string, weight int")
    return M.section_scores(a, w, "domain", "section")


@query(f"""with {DECIDED}, a as (select coalesce(domain, 'unknown') as domain, avg((side = gold_side)::int) as accuracy from decided group by 1),
w(domain, section, weight) as (values {", ".join(f"('{d}', '{'Reasoning' if s in ('CODE', 'STEM') else 'General'}', {n})" for d, s, n in DOMAINS)}),
s as (select section, sum(weight * accuracy) / sum(weight) as score from a join w using (domain) group by 1)
select round(avg(score), 6) as core_score, count(*)::bigint as n_sections from s""")  # fmt: skip
def core_score(spark: SparkSession, where: str) -> DataFrame:
    """The unweighted mean of the sections that have a subset."""
    return _sections(spark, where).agg(F.round(F.avg("score"), 6).alias("core_score"), F.count("*").alias("n_sections"))


@query(f"""with {COMPARED}, z as (select rubric_id, case gold_side when 'B' then -delta else delta end as z from compared join (select record_idx, gold_side from oriented) using (record_idx))
select coalesce(anchor_id, 'none') as anchor_id, count(*)::bigint as support_count from z join rubric_items using (rubric_id) where z > 0.05 group by 1""")  # fmt: skip
def support_counts(spark: SparkSession, where: str) -> DataFrame:
    """How often the rubrics of each anchor speak for a pair's chosen response."""
    gold = P.oriented(table(spark, where, "preferences")).select("record_idx", "gold_side")
    z = _compared(spark, where).select("record_idx", "rubric_id", "delta").join(gold, "record_idx").where(F.when(F.col("gold_side") == "B", -F.col("delta")).otherwise(F.col("delta")) > 0.05)
    anchors = table(spark, where, "rubric_items").select("rubric_id", F.coalesce("anchor_id", F.lit("none")).alias("anchor_id"))
    return z.join(anchors, "rubric_id").groupBy("anchor_id").agg(F.count("*").alias("support_count"))


@query(f"""with {COMPARED}, v as (select c.rubric_id, coalesce(o.domain, 'unknown') as grp, c.score_a >= {P.PASS} as yes from compared c join oriented o using (record_idx))
select rubric_id, count(*) filter (where yes)::bigint as yes_count, count(*)::bigint as n, round(avg(yes::int), 6) as vote_rate, count(distinct grp)::bigint as n_groups from v group by 1""")  # fmt: skip
def vote_rates_by_group(spark: SparkSession, where: str) -> DataFrame:
    domains = table(spark, where, "preferences").select("record_idx", F.coalesce("domain", F.lit("unknown")).alias("grp"))
    votes = _compared(spark, where).select("record_idx", "rubric_id", (F.col("score_a") >= P.PASS).alias("yes")).join(domains, "record_idx")
    r = K.vote_rates(votes)
    return r.select("rubric_id", "yes_count", "n", F.round("vote_rate", 6).alias("vote_rate"), F.size("group_rates").cast("long").alias("n_groups"))


@query()
def whitened_weights(spark: SparkSession, where: str) -> DataFrame:
    """Weights of the facets in each domain, from the facets' mean verdicts on each pair's response A."""
    domains = table(spark, where, "preferences").select("record_idx", T.domain("domain").alias("case_id"))
    votes = _compared(spark, where).groupBy("record_idx", "facet").agg(F.avg((F.col("score_a") >= P.PASS).cast("double")).alias("vote")).join(domains, "record_idx")
    return K.whitened_weights(votes.select("case_id", F.col("record_idx").alias("sample"), F.col("facet").alias("rubric"), "vote")).select("case_id", "rubric", F.round("weight", 6).alias("weight"))


@query()
def rubric_worklist(spark: SparkSession, where: str) -> DataFrame:
    """The rubrics of each example refined against its own responses."""
    r = table(spark, where, "rubric_items").where("text is not null").select(F.col("example_id").alias("case_id"), F.struct("pos", "rubric_id").alias("pos"), "text")
    prefs = table(spark, where, "preferences")
    side = lambda c, strong: prefs.where(F.trim(c) != "").select(F.col("example_id").alias("case_id"), F.col(c).alias("text"), F.lit(strong).alias("strong"))
    ranked = r.withColumn("pos", F.row_number().over(W.partitionBy("case_id").orderBy("pos")) - 1)
    return K.refine(ranked, side("chosen_response", True).unionAll(side("rejected_response", False)), many=1)


def _requests(spark: SparkSession, where: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, where, "preferences").where("prompt_text is not null").withColumn("namespace", F.coalesce("domain", F.lit("unknown")))
    keyed = p.withColumn("key", F.sha2(F.concat_ws("\n", "namespace", "prompt_text"), 256))
    return keyed.where("split <> 'train'"), keyed.where("split = 'train'")


_KEYED = "k as (select *, coalesce(domain, 'unknown') as namespace, sha256(concat_ws(chr(10), coalesce(domain, 'unknown'), prompt_text)) as key from preferences where prompt_text is not null)"


@query(f"""with {_KEYED}, c as (select distinct key, true as hit from k where split = 'train')
select namespace, count(hit)::bigint as hits, (count(*) - count(hit))::bigint as misses, round(count(hit)::double / count(*), 6) as hit_rate from (select * from k where split <> 'train') left join c using (key) group by 1""")  # fmt: skip
def cache_hit_rates(spark: SparkSession, where: str) -> DataFrame:
    return G.hit_rates(*_requests(spark, where))


@query(f"with {_KEYED} select distinct key from k where split <> 'train' and key not in (select key from k where split = 'train')")
def cache_misses(spark: SparkSession, where: str) -> DataFrame:
    return G.misses(*_requests(spark, where)).select("key")


@query("""select kind, count(*)::bigint as n_errors, sum(n)::bigint as n_rows from (select case when trim(coalesce(rejected_response, '')) = '' then 'empty_rejected' else 'empty_chosen' end as kind, coalesce(prompt_text, '') as prompt, count(*) as n
from preferences where trim(coalesce(rejected_response, '')) = '' or trim(coalesce(chosen_response, '')) = '' group by 1, 2) group by 1""")  # fmt: skip
def dead_letters(spark: SparkSession, where: str) -> DataFrame:
    bad = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    kind = F.when(bad("rejected_response"), "empty_rejected").otherwise("empty_chosen")
    errors = table(spark, where, "preferences").where(bad("rejected_response") | bad("chosen_response")).select(F.lit("pairs").alias("namespace"), kind.alias("kind"), F.col("prompt_text").alias("prompt"), F.lit(None).cast("string").alias("raw"))
    return G.dead_letters(errors).groupBy("kind").agg(F.count("*").alias("n_errors"), F.sum("n").alias("n_rows"))


@query(f"""with {COMPARED}, c as (select record_idx, floor((row_number() over (partition by record_idx order by rubric_id) - 1) / 8)::bigint as chunk, delta, weight from compared)
select record_idx, chunk, count(*)::bigint as n, round(sum(delta * weight), 6) as z from c group by 1, 2""")  # fmt: skip
def judge_chunks(spark: SparkSession, where: str) -> DataFrame:
    """Comparisons of a pair in chunks of eight, as one request of a served judge would hold them."""
    n = F.row_number().over(W.partitionBy("record_idx").orderBy("rubric_id"))
    c = _compared(spark, where).withColumn("chunk", F.floor((n - 1) / 8))
    return c.groupBy("record_idx", "chunk").agg(F.count("*").alias("n"), F.round(F.sum(F.col("delta") * F.col("weight")), 6).alias("z"))


@query(f"""with {COMPARED}, z as (select record_idx, rubric_id, case gold_side when 'B' then -delta else delta end as z from compared join (select record_idx, gold_side from oriented) using (record_idx)),
m as (select record_idx, max(z) as best, arg_max(rubric_id, (z, -rubric_id)) as best_id from z group by 1)
select record_idx, rubric_id, z from z join m using (record_idx) where z > 0.05 or (best <= 0.05 and best > 0 and rubric_id = best_id)""")  # fmt: skip
def payload_targets(spark: SparkSession, where: str) -> DataFrame:
    """Rubrics that speak for a pair's chosen response by more than 0.05, else its single best if that is above 0."""
    gold = P.oriented(table(spark, where, "preferences")).select("record_idx", "gold_side")
    z = _compared(spark, where).select("record_idx", "rubric_id", "delta").join(gold, "record_idx").withColumn("z", F.when(F.col("gold_side") == "B", -F.col("delta")).otherwise(F.col("delta")))
    m = z.groupBy("record_idx").agg(F.max("z").alias("best"), F.max_by("rubric_id", F.struct("z", -F.col("rubric_id"))).alias("best_id"))
    return z.join(m, "record_idx").where("z > 0.05 or (best <= 0.05 and best > 0 and rubric_id = best_id)").select("record_idx", "rubric_id", "z")


@query("""with d as (select regexp_extract(text, '(\\{[^{}]*\\})\\s*$', 1) as o from documents where text is not null),
j as (select json_extract_string(o, '$.verdict') as verdict, json_extract_string(o, '$.margin')::int as margin from d where o <> '' and json_valid(o))
select verdict, count(*)::bigint as n, sum(margin)::bigint as total_margin from j where verdict is not null group by 1""")  # fmt: skip
def parsed_verdicts(spark: SparkSession, where: str) -> DataFrame:
    o = F.regexp_extract("text", r"(\{[^{}]*\})\s*$", 1)
    d = table(spark, where, "documents").where("text is not null").select(T.first_object(o).alias("o")).where("o is not null")
    v = d.select(F.get_json_object("o", "$.verdict").alias("verdict"), F.get_json_object("o", "$.margin").cast("int").alias("margin"))
    return v.where("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"), F.sum("margin").alias("total_margin"))


@query("""select judge_model, mode, count(*)::bigint as n_docs, round(avg(n_chars), 6) as mean_chars, median(n_chars) as median_chars from documents join judge_runs using (run_id) group by 1, 2""")
def documents_by_judge(spark: SparkSession, where: str) -> DataFrame:
    """Documents of each judge; the runs are joined as a dimension, a hot run's documents need no shuffle for it."""
    d = table(spark, where, "documents").groupBy("run_id", "n_chars").agg(F.count("*").alias("n")).join(table(spark, where, "judge_runs").select("run_id", "judge_model", "mode"), "run_id")
    return d.groupBy("judge_model", "mode").agg(F.sum("n").alias("n_docs"), F.round(F.sum(F.col("n") * F.col("n_chars")) / F.sum("n"), 6).alias("mean_chars"), F.percentile("n_chars", 0.5, F.col("n")).alias("median_chars"))


@query()
def selector_training(spark: SparkSession, where: str) -> DataFrame:
    """The selector fitted to the pairs of train and chosen on those of dev: entries are facets, features hashed words of the prompt.

    The hard negative of a pair is the longest other rejected response of its example; ``z`` are facet sums of gold-aligned deltas.
    """
    prefs = table(spark, where, "preferences").where("prompt_text is not null")
    size = 32
    slot = F.pmod(F.xxhash64("w"), F.lit(size)).cast("int")
    words = prefs.select("record_idx", F.explode(T.tokens("prompt_text")).alias("w")).groupBy("record_idx").agg(*(F.count_if(slot == i).cast("double").alias(f"f{i}") for i in range(size)))
    norm = F.sqrt(sum((F.col(f"f{i}") * F.col(f"f{i}") for i in range(size)), F.lit(0.0)))
    x = words.select("record_idx", F.array(*(F.try_divide(F.col(f"f{i}"), norm) for i in range(size))).alias("x"))

    def facets(pairs: DataFrame, name: str) -> DataFrame:
        z = P.comparisons(pairs, table(spark, where, "rubric_items")).join(pairs.select("record_idx", "gold_side"), "record_idx").withColumn("z", F.when(F.col("gold_side") == "B", -F.col("delta")).otherwise(F.col("delta")))
        return z.groupBy("record_idx").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("facet") == f, F.col("z"))), F.lit(0.0)) for f in T.FACETS)).alias(name))

    pairs = P.oriented(table(spark, where, "preferences"))
    longest = prefs.where("trim(rejected_response) <> ''").groupBy("example_id").agg(F.max_by(F.struct("record_idx", "rejected_response"), F.struct(F.length("rejected_response"), "record_idx")).alias("h"))
    hard = prefs.join(longest, "example_id").where("record_idx <> h.record_idx").withColumn("rejected_response", F.col("h.rejected_response"))
    rows = prefs.select("record_idx", "split").join(x, "record_idx").join(facets(pairs, "z"), "record_idx").join(facets(P.oriented(hard), "adv"), "record_idx", "left")
    rows = rows.select("split", "x", "z", F.coalesce("adv", F.array_repeat(F.lit(0.0), len(T.FACETS))).alias("adv"), F.col("adv").isNotNull().cast("double").alias("mask")).persist(StorageLevel.MEMORY_AND_DISK)
    model = S.Selector(size, 16, len(T.FACETS))
    log = S.train(model, rows.where("split = 'train'"), rows.where("split = 'dev'"))
    out = [("weight", f, float(w)) for f, w in zip(T.FACETS, model.weights(), strict=True)] + [(c, str(i), float(v)) for i, e in enumerate(log) for c, v in e.items()]
    return spark.createDataFrame(out, "kind string, name string, value double")
