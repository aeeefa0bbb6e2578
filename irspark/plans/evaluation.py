"""Queries that judge: metrics against qrels, uncertainty, pooling, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diag, judging, metrics, runs
from ..session import written
from ..sources import tables as src
from .ranking import BRANCHES, RANKED, _B, _DOCS, _PAIR, TOP

KS = (5, 20)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _runs(spark, sf):
    return runs.ranked(_t(spark, sf, "runs"))


def _doc_scores(spark, sf):
    return metrics.doc_metrics(runs.doc_ranking(_runs(spark, sf)), _t(spark, sf, "qrels"), KS)


def score_docs(spark, sf):
    return _doc_scores(spark, sf)


def score_docs_macro(spark, sf):
    return metrics.macro(_doc_scores(spark, sf), ["branch", "k"], ["p", "r", "f2", "judged"])


def score_ndcg(spark, sf):
    return metrics.ndcg(_runs(spark, sf), _t(spark, sf, "qrels"))


def _unit_run(spark, sf):
    return _runs(spark, sf).where("rank <= 20").select("branch", "qid", "unit_id", "doc_id", "rank")


def unit_hits_lcs(spark, sf):
    q = _t(spark, sf, "qrels")
    texts = q.where("text is not null").groupBy("unit_id").agg(F.min("text").alias("text"))
    return metrics.unit_hits(_unit_run(spark, sf), texts, q)


def score_units(spark, sf):
    return metrics.unit_metrics(_unit_run(spark, sf), written(unit_hits_lcs(spark, sf), "hits"), _t(spark, sf, "qrels"), KS)


def boot_intervals(spark, sf):
    return metrics.intervals(_doc_scores(spark, sf).where("k = 20").drop("k"), ["branch"], ["p", "r", "f2"])


def paired_tests(spark, sf):
    return metrics.paired(_doc_scores(spark, sf).where("k = 20"), "f2", "rrf9")


def marginal_steps(spark, sf):
    return metrics.marginal(runs.doc_ranking(_runs(spark, sf)), _t(spark, sf, "qrels"), BRANCHES, TOP)


def split_halves(spark, sf):
    """Mean difference to rrf9 in two fixed halves of the queries, and whether its sign agrees."""
    d = _doc_scores(spark, sf).where("k = 20 and f2 is not null").select("branch", "qid", "f2")
    base = d.where("branch = 'rrf9'").select("qid", F.col("f2").alias("base"))
    x = d.where("branch <> 'rrf9'").join(base, "qid").withColumn("half", F.conv(F.left(F.md5(F.col("qid").cast("string")), F.lit(1)), 16, 10).cast("long") % 2)
    g = x.groupBy("branch").agg(*(F.round(F.avg(F.when(F.col("half") == h, F.col("f2") - F.col("base"))), 6).alias(f"d{h}") for h in (0, 1)))
    return g.withColumn("agree", F.sign("d0") == F.sign("d1"))


def _pairs20(spark, sf):
    docs = runs.doc_ranking(_runs(spark, sf)).where(F.col("branch").isin(BRANCHES))
    return diag.pairwise(docs, "doc_id", TOP)


def _vi(spark, sf):
    return src.query_texts(_t(spark, sf, "queries")).where("lang = 'vi'").select("qid", "query")


def query_strata(spark, sf):
    return judging.strata(_vi(spark, sf), _pairs20(spark, sf))


def stratified_select(spark, sf):
    return judging.select(judging.strata(_vi(spark, sf), _pairs20(spark, sf)), 60, 6)


SPECS = [(b, 5) for b in BRANCHES] + [("rrf9", 20)]


def pool_provenance(spark, sf):
    return judging.pool(_runs(spark, sf), SPECS)


def extend_pool(spark, sf):
    return judging.extension(judging.pool(_runs(spark, sf), SPECS), _t(spark, sf, "judge_key"))


def judging_sheets(spark, sf):
    return judging.sheets(_t(spark, sf, "judge_key").select("qid", "unit_id").distinct(), ["A", "B9", "C12", "D1"], 0.25)


def _labels(spark, sf):
    return written(judging.one_each(_t(spark, sf, "labels")), "labels")


def label_agreement(spark, sf):
    return judging.agreement(_labels(spark, sf))


def label_disagreements(spark, sf):
    return judging.disagreements(_labels(spark, sf), _t(spark, sf, "judge_key"))


def ingest_min_grade(spark, sf):
    return judging.qrels(_labels(spark, sf), _t(spark, sf, "judge_key"))


def qrels_per_query(spark, sf):
    return judging.per_query(metrics.judged(_t(spark, sf, "qrels")))


QUERIES = {
    f.__name__: f
    for f in (
        score_docs, score_docs_macro, score_ndcg, unit_hits_lcs, score_units, boot_intervals, paired_tests, marginal_steps, split_halves, query_strata, stratified_select, pool_provenance, extend_pool,
        judging_sheets, label_agreement, label_disagreements, ingest_min_grade, qrels_per_query,
    )
}

_J = """, j as (select qid, unit_id, max(doc_id) as doc_id, max(grade) as grade from qrels where grade is not null and qid is not null and unit_id is not null group by 1, 2),
jd as (select qid, doc_id, max(grade) as grade from j group by 1, 2), nr as (select qid, count(*) filter (grade >= 1) as n_rel from jd group by 1)
"""
_SCORES = _DOCS + _J + """, g as (select branch, qid, n_rel, k from nr, (select distinct branch from ranked), (values (5), (20)) as ks(k)),
s as (select branch, qid, k, count(*) as n, count(grade) as nj, count(*) filter (grade >= 1) as tp from docs left join jd using (qid, doc_id), (values (5), (20)) as ks(k) where rank <= k and qid in (select qid from nr) group by all),
x as (select branch, qid, k, n_rel, coalesce(n, 0) as n, coalesce(nj, 0) as nj, coalesce(tp, 0) as tp from g left join s using (branch, qid, k)),
m as (select *, case when n > 0 then tp / n else 0 end as p_, case when n_rel > 0 then tp / n_rel end as r_ from x),
sc as (select branch, qid, cast(k as bigint) as k, round(p_, 6) as p, round(case when nj > 0 then tp / nj end, 6) as pj, round(r_, 6) as r,
  round(case when n_rel > 0 then case when p_ + r_ > 0 then 5 * p_ * r_ / (4 * p_ + r_) else 0 end end, 6) as f2, round(case when n > 0 then nj / n end, 6) as judged from m)
"""
_ONE = """with o as (select item, labeler, max({'t': coalesce(tag, ''), 'g': -grade}) as x from labels where grade in (0, 1, 2) and item is not null and labeler is not null group by 1, 2),
l as (select item, labeler, x.t as tag, cast(-x.g as bigint) as grade from o)
"""
_VI = ", vi as (select id as qid, min(trim(query)) as query from queries where id is not null and query is not null and trim(lang) = 'vi' and trim(query) <> '' group by 1)"
_STRATA = RANKED.replace("ranked as", "units as") + ", ranked as (select branch, qid, doc_id as unit_id, row_number() over (partition by branch, qid order by best) as rank from (select branch, qid, doc_id, min(rank) as best from units group by 1, 2, 3))" + _PAIR.format(k=TOP, names=_B) + _VI + """,
d as (select qid, length(query) as len, round(1 - coalesce(j, 0), 6) as disagree from vi left join (select qid, avg(jaccard) as j from v group by 1) using (qid)),
e as (select *, row_number() over (order by len, qid) as a, row_number() over (order by disagree, qid) as b, count(*) over () as n from d),
st as (select qid, len, disagree, cast(case when n <= 1 then 0 else least(2, floor((a - 1) * 3 / (n - 1))) end as bigint) as len_bin, cast(case when n <= 1 then 0 else least(2, floor((b - 1) * 3 / (n - 1))) end as bigint) as dis_bin from e)
"""
_SPEC = "spec(branch, depth, no) as (values " + ", ".join(f"('{b}', {d}, {i})" for i, (b, d) in enumerate(SPECS)) + ")"
_POOL = RANKED + f", {_SPEC}, pool as (select qid, unit_id, doc_id, string_agg(branch || '@' || rank, ';' order by no) as src from ranked join spec using (branch) where rank <= depth group by all)\n"

_WORDS = "regexp_extract_all(regexp_replace(lower(nfc_normalize({})), '([㐀-䶿一-鿿豈-﫿])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
#: Hits of units by the table of longest common subsequences, row after row.
_HITS = (
    RANKED
    + ", gold as (select qid, unit_id as gold, doc_id, max(text) as gt from qrels where grade >= 1 and text is not null group by 1, 2, 3), run as (select branch, qid, unit_id, doc_id, rank from ranked where rank <= 20),"
    + "tx as (select unit_id, min(text) as t from qrels where text is not null group by 1),"
    + f"words as (select distinct unit_id, gold, {_WORDS.format('gt')} as g, {_WORDS.format('t')} as t from run join gold using (qid, doc_id) join tx using (unit_id) where unit_id <> gold),"
    + """lcs as (with recursive r as (select unit_id, gold, g, t, 0::bigint as i, list_transform(range(len(g) + 1), lambda x: 0::bigint) as row from words
union all select unit_id, gold, g, t, i + 1, list_transform(range(1, len(g) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when k > 1 and g[k - 1] = t[i + 1] then greatest(row[k], row[k - 1] + 1) else row[k] end))) from r where i < len(t))
select unit_id, gold from r where i = len(t) and row[len(g) + 1] / greatest(1, len(g)) >= 0.4),
hits as (select branch, qid, unit_id, rank, gold from run join gold using (qid, doc_id) where unit_id = gold or (unit_id, gold) in (select (unit_id, gold) from lcs))
"""
)
#: Draws of every judged query and round, as operators/metrics.py makes them.
_DRAWN = """, d0 as (select qid, r, ((qid % 2147483647) * 7919 + r * 104729 + 15485863) % 2147483647 as x from (select distinct qid from sc), range(2000) as t(r)),
d1 as (select qid, r, (x * x + 12345) % 2147483647 as x from d0), d2 as (select qid, r, (x * x + 67891) % 2147483647 as x from d1), d3 as (select qid, r, (x * x + 424243) % 2147483647 as x from d2),
w as (select qid, r, x, case when x / 2147483647.0 < 0.367879 then 0 when x / 2147483647.0 < 0.735759 then 1 when x / 2147483647.0 < 0.919699 then 2 when x / 2147483647.0 < 0.981012 then 3
  when x / 2147483647.0 < 0.99634 then 4 when x / 2147483647.0 < 0.999406 then 5 when x / 2147483647.0 < 0.999917 then 6 else 7 end as w from d3)"""

SQL = {
    "score_docs": _SCORES + "select * from sc",
    "score_docs_macro": _SCORES + "select branch, k, round(avg(p), 9) as p, round(avg(r), 9) as r, round(avg(f2), 9) as f2, round(avg(judged), 9) as judged, count(*) as n_q from sc group by all",
    "score_ndcg": RANKED + _J + """, i as (select qid, sum(grade / log2(i + 1)) as idcg from (select *, row_number() over (partition by qid order by grade desc, unit_id) as i from j) where i <= 10 group by 1),
g as (select branch, qid, sum(grade / log2(rank + 1)) as dcg from ranked join j using (qid, unit_id) where rank <= 10 group by 1, 2)
select branch, qid, round(case when idcg > 0 then coalesce(dcg, 0) / idcg end, 6) as ndcg from i cross join (select distinct branch from ranked) left join g using (branch, qid)""",
    "unit_hits_lcs": _HITS + "select * from hits",
    "score_units": _HITS + _J + """, n as (select qid, count(*) filter (grade >= 1) as n_rel from j group by 1), ks as (select unnest([5, 20]) as k),
c as (select branch, qid, k, count(*) as n from run cross join ks where rank <= k group by all), h as (select branch, qid, k, count(distinct unit_id) as ok, count(distinct gold) as found from hits cross join ks where rank <= k group by all),
x as (select branch, qid, k, n_rel, coalesce(n, 0) as n, coalesce(ok, 0) as ok, coalesce(found, 0) as found from n cross join (select distinct branch from run) cross join ks left join c using (branch, qid, k) left join h using (branch, qid, k)),
pr as (select *, case when n > 0 then ok / n else 0.0 end as p, case when n_rel > 0 then found / n_rel end as r from x)
select branch, qid, cast(k as bigint) as k, round(p, 6) as p, round(r, 6) as r, round(case when n_rel > 0 then case when 4 * p + r > 0 then 5 * p * r / (4 * p + r) else 0.0 end end, 6) as f2 from pr""",
    "boot_intervals": _SCORES + _DRAWN.replace("range(2000)", "range(1000)") + """, long as (select qid, branch, metric, value from (select qid, branch, p, r, f2 from sc where k = 20) unpivot (value for metric in (p, r, f2))),
mm as (select branch, metric, r, sum(w * value) / nullif(sum(w), 0) as m from long join w using (qid) group by all)
select branch, metric, max(n) as n, round(max(mean), 9) as mean, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high
from mm join (select branch, metric, count(*) as n, avg(value) as mean from long group by all) using (branch, metric) group by branch, metric""",
    "paired_tests": _SCORES + _DRAWN + """, d as (select a.branch, qid, a.f2 - b.f2 as d from sc a join sc b using (qid) where a.k = 20 and b.k = 20 and b.branch = 'rrf9' and a.branch <> 'rrf9' and a.f2 - b.f2 is not null),
whole as (select branch, count(*) as n, avg(d) as diff from d group by 1),
mm as (select branch, r, sum(w * d) / nullif(sum(w), 0) as m, avg(case when x % 2 = 0 then d else -d end) as flip from d join w using (qid) group by all)
select branch, max(n) as n, round(max(diff), 9) as diff, round(quantile_cont(m, 0.025), 9) as low, round(quantile_cont(m, 0.975), 9) as high, round(avg(case when abs(flip) >= abs(diff) - 1e-9 then 1.0 else 0.0 end), 9) as p
from mm join whole using (branch) group by branch""",
    "marginal_steps": _DOCS + _J + f""", f as (select qid, doc_id, min(list_position([{_B}], branch) - 1) as step from docs where branch in ({_B}) and rank <= {TOP} and qid in (select qid from jd) group by 1, 2),
x as (select step, count(*) as new, count(grade) as judged, count(*) filter (grade >= 1) as relevant from f left join jd using (qid, doc_id) group by 1),
s as (select unnest(range(9)) as step, unnest([{_B}]) as branch)
select step, branch, coalesce(new, 0) as new, coalesce(judged, 0) as judged, coalesce(relevant, 0) as relevant,
  round(sum(coalesce(relevant, 0)) over (order by step) / nullif((select count(*) from jd where grade >= 1), 0), 6) as recall from s left join x using (step)""",
    "split_halves": _SCORES + """, d as (select a.branch, a.f2 - b.f2 as d, list_position(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], md5(cast(a.qid as varchar))[1]) - 1 as h
  from sc a join sc b on a.qid = b.qid and b.branch = 'rrf9' and b.k = 20 where a.k = 20 and a.branch <> 'rrf9' and a.f2 is not null and b.f2 is not null),
hh as (select branch, round(avg(d) filter (h % 2 = 0), 6) as d0, round(avg(d) filter (h % 2 = 1), 6) as d1 from d group by 1) select *, sign(d0) = sign(d1) as agree from hh""",
    "query_strata": _STRATA + "select qid, len, disagree, len_bin, dis_bin from st",
    "stratified_select": _STRATA + """, h as (select qid, md5('13:' || qid) as h, row_number() over (partition by len_bin, dis_bin order by md5('13:' || qid)) as r from st),
k as (select qid, row_number() over (order by case when r > 6 then 1 else 0 end, h) as k from h) select qid, case when k <= 6 then 'pilot' else 'main' end as set from k where k <= 60""",
    "pool_provenance": _POOL + "select * from pool",
    "extend_pool": _POOL + "select * from pool where (qid, unit_id) not in (select (qid, unit_id) from judge_key)",
    "judging_sheets": """with items as (select distinct qid, unit_id from judge_key), q as (select qid, row_number() over (order by md5('13:' || qid)) - 1 as i, count(*) over () as n from (select distinct qid from items)),
w as (select qid, unnest(case when i < round(0.25 * n) then [i % 4, (i + 1) % 4] else [i % 4] end) as k from q)
select ['A', 'B9', 'C12', 'D1'][k + 1] as labeler, md5('13:' || qid || ':' || unit_id)[:8] as item, qid, unit_id from items join w using (qid)""",
    "label_agreement": _ONE + """, t as (select item, max(tag) as tag from l group by 1), p0 as (select t.tag, a.grade as a, b.grade as b from l a join l b on a.item = b.item and a.labeler <> b.labeler join t on t.item = a.item),
p as (select * from p0 union all select null, a, b from p0),
m as (select tag, count(*) as t, avg(case when a = b then 1.0 else 0.0 end) as po, avg(case when (a >= 1) = (b >= 1) then 1.0 else 0.0 end) as po2 from p group by 1),
e as (select tag, sum(s * s) as pe from (select tag, count(*) / sum(count(*)) over (partition by tag) as s from p group by tag, a) group by 1),
e2 as (select tag, sum(s * s) as pe2 from (select tag, count(*) / sum(count(*)) over (partition by tag) as s from p group by tag, a >= 1) group by 1)
select m.tag as tag, t // 2 as pairs, round(po, 6) as same, round(case when pe < 1 then (po - pe) / (1 - pe) else 1 end, 6) as kappa, round(case when pe2 < 1 then (po2 - pe2) / (1 - pe2) else 1 end, 6) as kappa2
from m join e on m.tag is not distinct from e.tag join e2 on m.tag is not distinct from e2.tag""",
    "label_disagreements": _ONE + ", g as (select item, min(grade) as g_min, max(grade) as g_max, count(*) as n from l group by 1) select item, qid, unit_id, g_min, g_max, n from g join (select distinct item, qid, unit_id from judge_key) using (item) where g_min < g_max",
    "ingest_min_grade": _ONE + ", g as (select item, min(grade) as grade, count(*) as n_labelers from l group by 1) select qid, unit_id, doc_id, grade, n_labelers from g join (select distinct item, qid, unit_id, doc_id from judge_key) using (item)",
    "qrels_per_query": "with j as (select qid, unit_id, max(grade) as grade from qrels where grade is not null and qid is not null and unit_id is not null group by 1, 2) select qid, count(*) as n, count(*) filter (grade >= 1) as rel, count(*) filter (grade >= 2) as rel2 from j group by 1",
}
