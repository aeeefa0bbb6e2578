"""Queries around models, with the implementations that need nothing from outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.siterules import SiteRule
from ..operators import dense, models, runs
from ..session import written
from ..sources import tables as src
from .ranking import RANKED
from .texts import NOTICE


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _units(spark, sf):
    x = _t(spark, sf, "qrels").where("text is not null and unit_id is not null").groupBy("unit_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    return x.withColumn("ctx", F.lit("")).withColumn("h", T.unit_hash(F.col("ctx"), F.col("text")))


def encoded_units(spark, sf):
    """Vectors of all units."""
    v = models.encode(_units(spark, sf), None, models.hashing_encoder())
    return v.select("unit_id", "h", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


def dense_branch(spark, sf):
    """Queries against units in the space of the hashing encoder, top ten."""
    v = written(models.encode(_units(spark, sf), None, models.hashing_encoder()), "units")
    q = src.query_texts(_t(spark, sf, "queries")).where("lang = 'vi'").select(F.col("qid").cast("string").alias("unit_id"), F.lit("").alias("h"), F.lit("").alias("ctx"), F.col("query").alias("text"))
    qv = models.encode(q, None, models.hashing_encoder()).select(F.col("unit_id").cast("long").alias("qid"), "v")
    return dense.exact(v, qv, 10)


def rerank_overlap(spark, sf):
    """The fused run's top 50 by word overlap with the query in the unit's language, then its tail."""
    run = runs.ranked(_t(spark, sf, "runs")).where("branch = 'rrf9'").select("qid", "unit_id", "doc_id", "rank")
    return models.rerank(run, _units(spark, sf), src.query_texts(_t(spark, sf, "queries")), models.overlap_scorer, 50)


def _html(spark, sf):
    e = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<html><head><title>"), e(F.col("title")), F.lit("</title></head><body><nav>menu</nav><div class='post body'><p>"), F.replace(e(T.to_plain(F.col("text"))), F.lit("\n"), F.lit("<p>")), F.lit("</div><footer>end</footer>"))
    return _t(spark, sf, "corpus").select("id", "url", "host", body.alias("html"))


def reextract(spark, sf):
    """Stored pages under a newer extractor, by a rule that fits every host."""
    rules = [SiteRule(s, keep=("div.post",), drop=(".ad",)) for s in ("test", "example", "invalid")]
    return models.extract_pages(_html(spark, sf), 99, rules, NOTICE).select("id", "host", "status", "extractor", F.col("xv").cast("long").alias("xv"), "text_hash", F.col("n_chars").cast("long").alias("n_chars"))


def fetch_replay(spark, sf):
    """Outcomes of fetching from a fixed table of answers."""
    links = _t(spark, sf, "pages").where("id is not null").groupBy("id").agg(F.min("url").alias("url"))
    return models.fetch(links, models.replay({}), tries=2).select("id", "host", "status", F.col("attempts").cast("long").alias("attempts"))


def fixed_sample(spark, sf):
    return models.sample(_t(spark, sf, "corpus").select("id", "host"), 50, "id")


QUERIES = {f.__name__: f for f in (encoded_units, dense_branch, rerank_overlap, reextract, fetch_replay, fixed_sample)}

SQL = {
    "encoded_units": "select unit_id, md5('' || chr(31) || min(text))[:12] as h, 64 as dim, case when len(regexp_extract_all(min(text), '[\\p{L}\\p{N}]')) > 0 then 1.0 else 0.0 end as norm from qrels where text is not null and unit_id is not null group by 1",
    "rerank_overlap": RANKED + """, run as (select qid, unit_id, doc_id, rank from ranked where branch = 'rrf9'),
un as (select unit_id, min(lang) as lang, min(text) as text from qrels where text is not null and unit_id is not null group by 1),
qt as (select id as qid, trim(lang) as lang, min(trim(query)) as query from queries where id is not null and query is not null and lang is not null and trim(query) <> '' group by 1, 2),
x as (select run.*, coalesce(own.query, other.query, '') as q, un.text as t from run join un using (unit_id) left join qt own on own.qid = run.qid and own.lang = un.lang left join qt other on other.qid = run.qid and other.lang = 'vi' where rank <= 50),
w as (select *, list_distinct(regexp_extract_all(regexp_replace(lower(q), '([㐀-䶿一-鿿豈-﫿])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')) as qw, list_distinct(regexp_extract_all(regexp_replace(lower(t), '([㐀-䶿一-鿿豈-﫿])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')) as tw from x),
top as (select qid, unit_id, doc_id, rank as old, round(len(list_intersect(qw, tw)) / greatest(1, len(qw)), 6) as score from w),
a as (select qid, unit_id, doc_id, score, row_number() over (partition by qid order by score desc, old, unit_id) as rank from top),
parts as (select qid, unit_id, doc_id, 0 as part, -score as key, rank as old from a union all select qid, unit_id, doc_id, 1, rank::double, rank from run where rank > 50)
select qid, unit_id, doc_id, part, row_number() over (partition by qid order by part, key, old, unit_id) as rank from parts""",
    "reextract": r"""with plain as (select id, host, title, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)^---$\n?', '', 'g'), '(?m)^(#{1,6} |- )', '', 'g'), '^\s+|\s+$', '', 'g') as t from corpus),
lines as (select id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'), ' |')), lambda x: x <> '') as l from plain),
x as (select id, host, array_to_string(l, chr(10)) as t from lines)
select id, host, 'ok' as status, 'rule' as extractor, 99 as xv, md5(regexp_replace(lower(t), '\s+', '', 'g'))[:16] as text_hash, length(t) as n_chars from x""",
    "fetch_replay": "select id, lower(regexp_extract(min(url), '^[a-z]+://([^/?#]+)', 1)) as host, 'http_404' as status, 1 as attempts from pages where id is not null group by 1",
    "fixed_sample": "select id, host from (select id, host, row_number() over (order by md5('13:' || id), id) as r from corpus) where r <= 50",
}
