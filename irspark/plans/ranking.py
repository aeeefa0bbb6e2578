"""Queries over ranked lists: run algebra, fusion, diagnostics, submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diag, fusion, runs
from ..session import written
from ..sources import tables as src

BRANCHES = [f"{lang}_{kind}" for lang in ("vi", "en", "zh") for kind in ("dense", "lsr", "bm25")]
CONFIGS = {"rrf9": BRANCHES, "rrf_vi": [b for b in BRANCHES if b.startswith("vi")], "rrf_dense3": [b for b in BRANCHES if b.endswith("dense")], "rrf9_w": [b + ("*0.5" if b.endswith("bm25") else "") for b in BRANCHES]}
DEPTH, TOP = 1000, 20


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.ranked(_t(spark, sf, "runs"))


def run_ranked(spark, sf):
    return _runs(spark, sf)


def run_depth_qids(spark, sf):
    q = _t(spark, sf, "qrels").select("qid")
    return runs.at_depth(_runs(spark, sf), 50, q)


def run_to_parents(spark, sf):
    children = _runs(spark, sf).withColumn("unit_id", F.concat("unit_id", F.lit("_c"), (F.col("rank") % 3).cast("string")))
    return runs.to_parents(children)


def run_doc_ranking(spark, sf):
    return runs.doc_ranking(_runs(spark, sf))


def run_top_lists(spark, sf):
    return runs.top_lists(_runs(spark, sf), 10).select("branch", "qid", F.array_join("items", ",").alias("items"))


def run_from_arrays(spark, sf):
    lists = runs.top_lists(_runs(spark, sf), 5).withColumn("scores", F.transform("items", lambda x, i: 1 / (i + 1))).withColumnRenamed("items", "units")
    return runs.from_arrays(lists).withColumn("score", F.round("score", 6))


def rerank_with_tail(spark, sf):
    r = _runs(spark, sf)
    base, top = r.where("branch = 'rrf9'"), r.where("branch = 'rerank' and rank <= 50")
    return runs.with_tail(top, base, 50)


def interleave_union(spark, sf):
    return runs.interleaved(_runs(spark, sf), ["vi_bm25", "en_bm25", "zh_bm25"], 50)


def _fused(spark, sf, cut=None):
    have = fusion.complete(_t(spark, sf, "runs"), CONFIGS)  # names only, without ranking
    return fusion.rrf(_runs(spark, sf), fusion.config(spark, have), DEPTH, cut=cut)


def rrf_configs(spark, sf):
    return _fused(spark, sf, cut=100)


def rrf_levels(spark, sf):
    """Parents and children of one branch as two lists."""
    r = _runs(spark, sf).where("branch = 'vi_dense'")
    return fusion.levels(r, r.withColumn("unit_id", F.concat("unit_id", F.lit("_c0"))), 100)


def pairwise_overlap(spark, sf):
    r = _runs(spark, sf).where(F.col("branch").isin(BRANCHES))
    return diag.pair_means(diag.pairwise(r, "unit_id", TOP))


def pairwise_per_query(spark, sf):
    r = _runs(spark, sf).where(F.col("branch").isin("vi_dense", "en_dense", "zh_dense"))
    return diag.pairwise(r, "unit_id", 10)


def exclusive_docs(spark, sf):
    return diag.exclusive(runs.doc_ranking(_runs(spark, sf)).where(F.col("branch").isin(BRANCHES)), "doc_id", TOP)


def union_growth(spark, sf):
    return diag.union_growth(runs.doc_ranking(_runs(spark, sf)), "doc_id", BRANCHES, TOP)


def greedy_order(spark, sf):
    order = diag.greedy_order(runs.doc_ranking(_runs(spark, sf)), "doc_id", BRANCHES, TOP)
    return spark.createDataFrame([(i + 1, b) for i, b in enumerate(order)], "step long, branch string")


def lang_profile(spark, sf):
    langs = _t(spark, sf, "corpus").select(F.col("id").alias("doc_id"), "lang")
    return diag.lang_profile(runs.doc_ranking(_runs(spark, sf)), langs, TOP)


def composition(spark, sf):
    r = written(_runs(spark, sf).where(F.col("branch").isin(BRANCHES)), "runs")
    fused = fusion.rrf(r, fusion.config(spark, {"rrf9": BRANCHES}), DEPTH, cut=TOP)
    return diag.composition(fused, r, TOP, 100)


def leave_one_out(spark, sf):
    r = _runs(spark, sf).where(F.col("branch").isin(BRANCHES))
    return diag.leave_one_out(spark, r, BRANCHES, DEPTH, TOP)


def rrf_k_sensitivity(spark, sf):
    r = _runs(spark, sf).where(F.col("branch").isin(BRANCHES))
    return diag.k_sensitivity(spark, r, BRANCHES, DEPTH, TOP)


def rerank_change_tau(spark, sf):
    r = _runs(spark, sf)
    return diag.rerank_change(r.where("branch = 'rrf9'"), r.where("branch = 'rerank'"), TOP)


def submission_docs(spark, sf):
    units = _t(spark, sf, "relevant_chunks").select(F.concat(F.col("doc_id").cast("string"), F.lit("_p0")).alias("unit_id"), F.col("chunk_text").alias("text")).groupBy("unit_id").agg(F.min("text").alias("text"))
    return runs.submission(_fused(spark, sf, 400).where("config = 'rrf9'"), units)[0]


def submission_chunks(spark, sf):
    units = _t(spark, sf, "qrels").where("text is not null").groupBy("unit_id").agg(F.min("text").alias("text"))
    return runs.submission(_fused(spark, sf, 400).where("config = 'rrf9'"), units)[1]


def submission_violations(spark, sf):
    f = _fused(spark, sf, 100).where("config = 'rrf9'")
    docs = f.groupBy("qid", "doc_id").agg(F.min("rank").alias("rank"))
    qids = _t(spark, sf, "queries").where("id is not null").select(F.col("id").alias("qid")).distinct()
    return runs.violations(docs, f.select("qid", "unit_id"), qids, _t(spark, sf, "corpus"))


QUERIES = {
    f.__name__: f
    for f in (
        run_ranked, run_depth_qids, run_to_parents, run_doc_ranking, run_top_lists, run_from_arrays, rerank_with_tail, interleave_union, rrf_configs, rrf_levels, pairwise_overlap,
        pairwise_per_query, exclusive_docs, union_growth, greedy_order, lang_profile, composition, leave_one_out, rrf_k_sensitivity, rerank_change_tau, submission_docs, submission_chunks, submission_violations,
    )
}

RANKED = """with best as (select branch, qid, unit_id, max(doc_id) as doc_id, max(cast(score as double)) as score from runs
  where score is not null and not isnan(score) and unit_id is not null group by 1, 2, 3),
ranked as (select *, row_number() over (partition by branch, qid order by score desc, unit_id) as rank from best)
"""
_B = ", ".join(f"'{b}'" for b in BRANCHES)
_DOCS = RANKED + """, docs as (select branch, qid, doc_id, row_number() over (partition by branch, qid order by best) as rank
  from (select branch, qid, doc_id, min(rank) as best from ranked group by 1, 2, 3))
"""


def _cfg(configs: dict[str, list[str]]) -> str:
    return "cfg(config, branch, weight) as (values " + ", ".join(f"('{c}', '{b}', {w}::double)" for c, s in configs.items() for b, w in map(fusion.parse_item, s)) + ")"


def _rrf(configs: dict[str, list[str]], cut: int, source: str = "ranked", k: str = "60", extra: str = "") -> str:
    return f""", {_cfg(configs)}, summed as (select config{extra}, qid, unit_id, doc_id, round(sum(weight / ({k} + rank)), 12) as score, min(rank) as best
  from {source} join cfg using (branch) where rank <= {DEPTH} group by all),
fused as (select * exclude (best) from (select *, row_number() over (partition by config{extra}, qid order by score desc, best, unit_id) as rank from summed) where rank <= {cut})
"""


_PAIR = """, lists as (select branch, qid, unit_id as item, rank from ranked where rank <= {k} and branch in ({names})),
n as (select branch, qid, count(*) as n from lists group by all),
pairs as (select x.branch as a, y.branch as b, x.qid, x.n as na, y.n as nb from n x join n y on x.qid = y.qid and x.branch < y.branch),
common_ as (select x.branch as a, y.branch as b, x.qid, greatest(x.rank, y.rank) as m from lists x join lists y on x.qid = y.qid and x.item = y.item and x.branch < y.branch),
c as (select a, b, qid, count(*) as c from common_ group by all),
r as (select a, b, qid, sum(pow(0.9, d - 1) / d) as s from (select c.a, c.b, c.qid, unnest(range(m, least(na, nb) + 1)) as d from common_ c join pairs p on c.a = p.a and c.b = p.b and c.qid = p.qid) group by all),
v as (select p.a, p.b, p.qid, round(coalesce(c, 0) / (na + nb - coalesce(c, 0)), 6) as jaccard, round(coalesce(c, 0) / least(na, nb), 6) as overlap, round(0.1 * coalesce(s, 0), 9) as rbo
  from pairs p left join c using (a, b, qid) left join r using (a, b, qid))
"""

_STEP = "list_position([" + _B + "], branch) - 1"

SQL = {
    "run_ranked": RANKED + "select branch, qid, unit_id, doc_id, score, rank from ranked",
    "run_depth_qids": RANKED + "select branch, qid, unit_id, doc_id, score, rank from ranked where rank <= 50 and qid in (select qid from qrels)",
    "run_to_parents": RANKED + "select branch, qid, unit_id, doc_id, row_number() over (partition by branch, qid order by rank, unit_id) as rank, score from ranked",
    "run_doc_ranking": _DOCS + "select branch, qid, doc_id, rank from docs",
    "run_top_lists": RANKED + "select branch, qid, string_agg(unit_id, ',' order by rank) as items from ranked where rank <= 10 group by all",
    "run_from_arrays": RANKED + "select branch, qid, unit_id, cast(split_part(unit_id, '_', 1) as bigint) as doc_id, rank, round(1.0 / rank, 6)::double as score from ranked where rank <= 5",
    "rerank_with_tail": RANKED + """, parts as (select qid, unit_id, doc_id, 0 as part, -score as key, rank as old from ranked where branch = 'rerank' and rank <= 50
 union all select qid, unit_id, doc_id, 1, rank::double, rank from ranked where branch = 'rrf9' and rank > 50)
select qid, unit_id, doc_id, part, row_number() over (partition by qid order by part, key, old, unit_id) as rank from parts""",
    "interleave_union": RANKED + """, numbered as (select qid, unit_id, doc_id, rank, list_position(['vi_bm25', 'en_bm25', 'zh_bm25'], branch) as no from ranked where branch in ('vi_bm25', 'en_bm25', 'zh_bm25')),
f as (select qid, unit_id, doc_id, min({'r': rank, 'n': no}) as w_ from numbered group by 1, 2, 3)
select * from (select qid, unit_id, doc_id, row_number() over (partition by qid order by w_, unit_id) as rank from f) where rank <= 50""",
    "greedy_order": _DOCS + f""", b as (select [{_B}] as names), ms as (select list({{'m': m, 'n': n}}) as ms from (select m, count(*) as n from (select qid, doc_id, bit_or(1 << (list_position(names, branch) - 1)) as m from docs, b where branch in ({_B}) and rank <= {TOP} group by 1, 2) group by 1)),
g as (with recursive g as (select 0::bigint as step, 0::bigint as have, -1::bigint as i, [-1::bigint] as done union all select step + 1, have | (1 << i2), i2, list_append(done, i2) from (
  select step, have, done, 99 - (list_max(list_transform(list_filter(range(9), lambda k: not list_contains(done, k)), lambda k: 100 * coalesce(list_sum(list_transform(list_filter(ms, lambda x: (x.m >> k) & 1 = 1 and (x.m & have) = 0), lambda x: x.n)), 0) + 99 - k)) % 100)::bigint as i2 from g, ms where step < 9))
  select * from g)
select step, names[i + 1] as branch from g, b where step > 0""",
    "rrf_configs": RANKED + _rrf(CONFIGS, 100) + "select config, qid, unit_id, doc_id, rank, score from fused",
    "rrf_levels": RANKED + """, c as (select branch, qid, unit_id, doc_id, row_number() over (partition by branch, qid order by rank, unit_id) as rank from ranked where branch = 'vi_dense' and rank <= 300),
both_ as (select branch, qid, unit_id, doc_id, rank from ranked where branch = 'vi_dense' and rank <= 100 union all select * from c where rank <= 100),
s as (select branch, qid, unit_id, doc_id, round(sum(1 / (60 + rank)), 12) as score, min(rank) as best from both_ group by 1, 2, 3, 4)
select branch, qid, unit_id, doc_id, rank, score from (select *, row_number() over (partition by branch, qid order by score desc, best, unit_id) as rank from s) where rank <= 100""",
    "pairwise_overlap": RANKED + _PAIR.format(k=TOP, names=_B) + "select a, b, count(*) as n_q, round(avg(jaccard), 9) as jaccard, round(avg(overlap), 9) as overlap, round(avg(rbo), 9) as rbo from v group by all",
    "pairwise_per_query": RANKED + _PAIR.format(k=10, names="'vi_dense', 'en_dense', 'zh_dense'") + "select a, b, qid, jaccard, overlap, rbo from v",
    "exclusive_docs": _DOCS + f""", t as (select branch, qid, doc_id from docs where rank <= {TOP} and branch in ({_B})),
one as (select qid, doc_id, min(branch) as branch from t group by 1, 2 having count(*) = 1),
per as (select branch, qid, count(*) as n from one group by all)
select branch, round(avg(coalesce(n, 0)), 6) as mean from (select distinct branch, qid from t) left join per using (branch, qid) group by branch""",
    "union_growth": _DOCS + f""", t as (select qid, doc_id, min({_STEP}) as step from docs where rank <= {TOP} and branch in ({_B}) group by 1, 2),
s as (select unnest(range(9)) as step, unnest([{_B}]) as branch),
g as (select s.step, s.branch, count(t.qid) / (select count(distinct qid) from t) as n from s left join t using (step) group by 1, 2)
select step, branch, round(n, 6) as new_mean, round(sum(n) over (order by step), 6) as union_mean from g""",
    "lang_profile": _DOCS + f""", x as (select branch, case when lang in ('vi', 'en', 'zh') then lang else '?' end as lang from docs left join (select id as doc_id, lang from corpus) using (doc_id) where rank <= {TOP})
select branch, lang, round(count(*) / sum(count(*)) over (partition by branch), 6) as share from x group by 1, 2""",
    "composition": RANKED + _rrf({"rrf9": BRANCHES}, TOP) + f""", b as (select branch, qid, unit_id from ranked where rank <= 100 and branch in ({_B})),
x as (select f.qid, f.unit_id, count(b.branch) as support, min(b.branch) as one from fused f left join b using (qid, unit_id) group by 1, 2)
select support, case when support = 1 then one end as sole_branch, count(*) as n from x group by all""",
    "leave_one_out": RANKED + _rrf({"": BRANCHES} | {b: [x for x in BRANCHES if x != b] for b in BRANCHES}, TOP) + f""", nf as (select qid, count(*) as nf from fused where config = '' group by qid),
np as (select config, qid, count(*) as np from fused where config <> '' group by all),
c as (select p.config, p.qid, count(*) as c from fused p join fused f on p.qid = f.qid and p.unit_id = f.unit_id and f.config = '' where p.config <> '' group by all),
r as (select unnest([{_B}]) as config)
select config as removed, round(avg(coalesce(c, 0) / (nf + coalesce(np, 0) - coalesce(c, 0))), 6) as jaccard from nf cross join r left join np using (config, qid) left join c using (config, qid) group by 1""",
    "rrf_k_sensitivity": RANKED + ", kr as (select r.*, k from ranked r, (values (60), (10), (30), (100)) as ks(k))" + _rrf({"all": BRANCHES}, TOP, "kr", "k", ", k") + """, n as (select qid, count(*) as n from fused where k = 60 group by qid),
c as (select a.k, a.qid, count(*) as c from fused a join fused b on a.qid = b.qid and a.unit_id = b.unit_id and b.k = 60 where a.k <> 60 group by all)
select cast(o.k as bigint) as k, round(avg(coalesce(c, 0) / n), 6) as kept from n cross join (values (10), (30), (100)) as o(k) left join c on c.k = o.k and c.qid = n.qid group by 1""",
    "rerank_change_tau": RANKED + f""", a as (select qid, unit_id, rank as ra from ranked where branch = 'rrf9' and rank <= {TOP}), b as (select qid, unit_id, rank as rb from ranked where branch = 'rerank' and rank <= {TOP}),
n as (select * from (select qid, count(*) as na from a group by 1) join (select qid, count(*) as nb from b group by 1) using (qid)),
m as (select qid, unit_id, ra, rb from a join b using (qid, unit_id)), c as (select qid, count(*) as c from m group by 1),
s as (select x.qid, sum(case when x.rb < y.rb then 1 else -1 end) as s from m x join m y on x.qid = y.qid and x.ra < y.ra group by 1)
select qid, round(coalesce(c, 0) / (na + nb - coalesce(c, 0)), 6) as jaccard, case when c >= 3 then round(s / (c * (c - 1) / 2), 6) end as tau from n left join c using (qid) left join s using (qid)""",
    "submission_docs": RANKED + _rrf(CONFIGS, 400) + """, d as (select qid, doc_id, min(rank) as best from fused where config = 'rrf9' group by 1, 2)
select * from (select qid, doc_id, row_number() over (partition by qid order by best) as rank from d) where rank <= 200""",
    "submission_chunks": RANKED + _rrf(CONFIGS, 400) + r""", u as (select unit_id, min(text) as text from qrels where text is not null group by 1),
x as (select f.qid, f.doc_id, f.unit_id, f.rank, lower(regexp_replace(text, '[ \n\t\r]+', ' ', 'g'))[:300] as key from fused f join u using (unit_id) where config = 'rrf9'),
o as (select qid, doc_id, key, min({'r': rank, 'u': unit_id}) as w_ from x group by 1, 2, 3)
select * from (select qid, doc_id, w_.u as unit_id, row_number() over (partition by qid order by w_.r, w_.u) as rank from o) where rank <= 185""",
    "submission_violations": RANKED + _rrf(CONFIGS, 100) + """, d as (select distinct qid, doc_id from fused where config = 'rrf9'), q as (select distinct id as qid from queries where id is not null)
select 'missing query' as problem, qid, '' as what from q where qid not in (select qid from d)
union all select 'unknown document', qid, cast(doc_id as varchar) from d where doc_id not in (select id from corpus)
union all select distinct 'unexpected query', qid, '' from d where qid not in (select qid from q)""",
}
