"""Queries over what is written and read again, and over small kernels that have no table of their own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import text as T
from ..functions.dates import partial_date
from ..operators import judging, runs, translate
from ..session import work_path
from ..sources import sinks
from ..sources import tables as src
from ..streaming import ingest
from .evaluation import _SCORES, _doc_scores
from .ranking import RANKED


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run_round_trip(spark, sf):
    """A run file as it is read after it was written."""
    path = work_path(spark, "run")
    sinks.run(runs.ranked(_t(spark, sf, "runs")).where("branch = 'vi_bm25'"), path)
    return spark.read.parquet(path).select("qid", "unit_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round(F.col("score").cast("double"), 4).alias("score"))


def postings_round_trip(spark, sf):
    """Sparse weights by language and term as they are read after they were written; one language's folder alone is read."""
    q = src.query_texts(_t(spark, sf, "queries"))
    words = q.select("qid", "lang", F.explode(F.split(F.lower("query"), " ")).alias("term")).where("term <> ''")
    path = work_path(spark, "postings")
    sinks.postings(words.groupBy("lang", "term", "qid").agg(F.count("*").alias("weight")), path)
    return spark.read.parquet(path).where("lang = 'vi'").select("term", "qid", "weight")


def corpus_files(spark, sf):
    """Rows of a corpus written in parts, and whether every part keeps to its size."""
    path = work_path(spark, "corpus")
    sinks.corpus(_t(spark, sf, "corpus"), path, rows=200)
    files = spark.read.parquet(path).groupBy("_metadata.file_path").agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 200).alias("bounded"))


def listed_queries(spark, sf):
    """Rows of runs by the ids of a list in a file with a column id."""
    path = work_path(spark, "ids") + ".csv"
    _t(spark, sf, "queries").where("lang = 'en'").select("id").write.option("header", True).csv(path)
    return _t(spark, sf, "runs").join(src.ids(spark, path), "qid", "left_semi").groupBy("qid").agg(F.count("*").alias("n"))


def appended_attempts(spark, sf):
    """Attempts that a stream appended to a log, each once."""
    came, log, state = (work_path(spark, x) for x in ("arrived", "log", "state"))
    _t(spark, sf, "pages").write.option("maxRecordsPerFile", 500).parquet(came)
    ingest.append(ingest.attempts(spark, came, 2), log, state).awaitTermination()
    return spark.read.parquet(log).groupBy("id").agg(F.count("*").alias("attempts"), F.max("processed_at").alias("last"))


def labels_wide(spark, sf):
    """Labels pivoted to a column for each labeler and back."""
    x = _t(spark, sf, "labels").where("grade in (0, 1, 2) and labeler is not null and item is not null")
    names = [r[0] for r in x.select("labeler").distinct().orderBy("labeler").collect()]
    return judging.by_labeler(x, names).unpivot(["item"], names, "labeler", "grade").where("grade is not null").select("item", "labeler", F.col("grade").cast("long").alias("grade"))


def folded_titles(spark, sf):
    @F.pandas_udf("string")
    def fold(t: pd.Series) -> pd.Series:
        return t.map(kernels.fold)

    return _t(spark, sf, "corpus").select("id", fold("title").alias("folded"))


def head_terms(spark, sf):
    """First variants of terms that are listed with semicolons and brackets."""
    t = F.concat_ws("; ", F.concat("section", F.lit(" ("), F.coalesce("lang", F.lit("?")), F.lit(")")), "host")
    return _t(spark, sf, "corpus").where("section is not null").select("id", T.head_term(t).alias("term"))


def partial_dates(spark, sf):
    """Dates of which the month or the day may be missing; months by number and name."""
    o = _t(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").cast("string").alias("d"))
    names = F.array(*map(F.lit, ("January", "Feb", "March", "Apr", "May", "June", "Jul", "August", "Sep", "October", "Nov", "Dec")))
    month = F.when(F.col("o_orderkey") % 3 == 0, F.element_at(names, F.col("m"))).when(F.col("o_orderkey") % 3 == 1, F.col("m").cast("string"))
    return o.select("o_orderkey", partial_date(F.col("y"), month, F.when(F.col("o_orderkey") % 2 == 0, F.col("d"))).alias("iso"))


def fetch_routes(spark, sf):
    """Links by the way they are fetched: records of the bibliography, and pages of the web."""
    x = _t(spark, sf, "pages").where("id is not null").groupBy("id").agg(F.min("url").alias("url"))
    return x.groupBy(T.route(F.col("url")).alias("route")).agg(F.count("*").alias("n"))


def sign_tests(spark, sf):
    """Queries on which a branch is better or worse than rrf9, with the sign test's probability."""
    x = _doc_scores(spark, sf).where("k = 20")
    base = x.where("branch = 'rrf9'").select("qid", F.col("f2").alias("b"))
    w = x.where("branch <> 'rrf9'").join(base, "qid").groupBy("branch").agg(F.count_if(F.col("f2") > F.col("b")).alias("wins"), F.count_if(F.col("f2") < F.col("b")).alias("losses"))

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([round(translate.sign_test(int(x), int(y)), 9) for x, y in zip(a, b)])

    return w.select("branch", "wins", "losses", p("wins", "losses").alias("p"))


QUERIES = {f.__name__: f for f in (run_round_trip, postings_round_trip, corpus_files, listed_queries, appended_attempts, labels_wide, folded_titles, head_terms, partial_dates, fetch_routes, sign_tests)}

SQL = {
    "run_round_trip": RANKED + "select qid, unit_id, doc_id, rank, round(cast(cast(score as float) as double), 4) as score from ranked where branch = 'vi_bm25'",
    "postings_round_trip": """with q as (select id as qid, trim(lang) as lang, min(trim(query)) as query from queries where id is not null and query is not null and lang is not null and trim(query) <> '' group by 1, 2)
select term, qid, count(*) as weight from (select qid, unnest(string_split(lower(query), ' ')) as term from q where lang = 'vi') where term <> '' group by 1, 2""",
    "corpus_files": "select count(*) as n_rows, true as bounded from corpus",
    "listed_queries": "select qid, count(*) as n from runs where qid in (select id from queries where lang = 'en') group by 1",
    "appended_attempts": "select id, count(*) as attempts, max(processed_at) as last from pages group by 1",
    "labels_wide": "select item, labeler, cast(min(grade) as bigint) as grade from labels where grade in (0, 1, 2) and labeler is not null and item is not null group by 1, 2",
    "folded_titles": "select id, regexp_replace(strip_accents(replace(lower(coalesce(title, '')), 'đ', 'd')), '[^a-z0-9]', '', 'g') as folded from corpus",
    "head_terms": "select id, trim(regexp_replace(regexp_extract(concat_ws('; ', section || ' (' || coalesce(lang, '?') || ')', host), '^([^;/；]*)', 1), '[(（][^)）]*[)）]', '', 'g')) as term from corpus where section is not null",
    "partial_dates": "select o_orderkey, case when o_orderkey % 3 = 2 then strftime(o_orderdate, '%Y') when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%m') end as iso from orders",
    "fetch_routes": "select case when u like '%pubmed.ncbi.nlm.nih.gov/%' then 'bibliography' else 'web' end as route, count(*) as n from (select id, min(url) as u from pages where id is not null group by 1) group by 1",
    "sign_tests": _SCORES + """, w as (select a.branch, count(*) filter (a.f2 > b.f2) as wins, count(*) filter (a.f2 < b.f2) as losses from sc a join sc b using (qid) where a.k = 20 and b.k = 20 and b.branch = 'rrf9' and a.branch <> 'rrf9' group by 1)
select branch, wins, losses, round(least(1.0, coalesce(2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2)))), 1.0)), 9) as p from w""",
}
