"""Queries that retrieve: BM25 branches, learned-sparse weights, dense vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, dense, runs
from ..session import written
from ..sources import tables as src


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _units(spark, sf, lang: str) -> DataFrame:
    """One unit per document of the corpus: title and plain text."""
    c = _t(spark, sf, "corpus").where(F.col("lang") == lang)
    return c.select(F.concat(F.col("id").cast("string"), F.lit("_p0")).alias("unit_id"), F.concat_ws("\n", F.nullif("title", F.lit("")), "text").alias("text"))


def _queries(spark, sf, lang: str) -> DataFrame:
    return src.query_texts(_t(spark, sf, "queries")).where(F.col("lang") == lang).select("qid", "query")


def _branch(spark, sf, lang, tokens, k1=bm25.K1, b=bm25.B):
    return bm25.bm25(_units(spark, sf, lang), _queries(spark, sf, lang), tokens, 10, k1, b)


def bm25_en_top10(spark, sf):
    return _branch(spark, sf, "en", bm25.tokens_en)


def bm25_vi_top10(spark, sf):
    return _branch(spark, sf, "vi", bm25.tokens_any)


def bm25_zh_top10(spark, sf):
    return _branch(spark, sf, "zh", bm25.tokens_any)


def bm25_k1b_variant(spark, sf):
    return _branch(spark, sf, "en", bm25.tokens_en, 0.9, 0.4)


def bm25_vocab_df(spark, sf):
    tf, dl = bm25.postings(_units(spark, sf, "en"), bm25.tokens_en(F.col("text")))
    return bm25.statistics(tf, dl)[0]


def bm25_stats(spark, sf):
    tf, dl = bm25.postings(_units(spark, sf, "en"), bm25.tokens_en(F.col("text")))
    return bm25.statistics(tf, dl)[1].withColumn("avgdl", F.round("avgdl", 6))


def bm25_weights(spark, sf):
    tf, dl = bm25.postings(_units(spark, sf, "en"), bm25.tokens_en(F.col("text")))
    return bm25.weights(tf, dl).withColumn("weight", F.round("weight", 6))


def lsr_top10(spark, sf):
    """Learned-sparse search with given weights: here the share of a term in its unit, in one space for all languages."""
    units = _t(spark, sf, "qrels").where("text is not null").groupBy("unit_id").agg(F.min("text").alias("text"))
    tf, dl = bm25.postings(units, bm25.tokens_any(F.col("text")))
    w = tf.join(dl, "unit_id").select("unit_id", "term", (F.col("tf") / F.col("dl")).alias("weight"))
    q = src.query_texts(_t(spark, sf, "queries")).select("qid", "query")
    return bm25.search(w, written(bm25.query_terms(q, bm25.tokens_any(F.col("query"))), "terms"), 10)


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("v"), "label")


def _dense_queries(spark, sf):
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, sf).where("unit_id % 20 = 0").select(F.col("unit_id").alias("qid"), "v")


def dense_top10(spark, sf):
    return dense.exact(_vectors(spark, sf), _dense_queries(spark, sf), 10)


def dense_ivf_top10(spark, sf):
    return dense.ivf(_vectors(spark, sf), _dense_queries(spark, sf), 10)


def dense_ivf_recall(spark, sf):
    """Share of the exact ten that the inverted lists find."""
    a = written(dense.exact(_vectors(spark, sf), _dense_queries(spark, sf), 10), "exact")
    b = dense.ivf(_vectors(spark, sf), _dense_queries(spark, sf), 10).select("qid", "unit_id", F.lit(1).alias("hit"))
    return a.join(b, ["qid", "unit_id"], "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def dense_label_precision(spark, sf):
    """Share of neighbours with the query's label, the query itself left out."""
    lab = _vectors(spark, sf).select("unit_id", "label")
    x = dense.exact(_vectors(spark, sf), _dense_queries(spark, sf), 11).where("qid <> unit_id")
    x = x.join(lab, "unit_id").join(lab.select(F.col("unit_id").alias("qid"), F.col("label").alias("want")), "qid")
    return x.groupBy("qid").agg(F.round(F.avg((F.col("label") == F.col("want")).cast("double")), 6).alias("precision"))


def maxsim_pairs(spark, sf):
    """Pseudo-documents of four vectors against queries of two."""
    v = _vectors(spark, sf)
    docs = v.groupBy(F.concat(F.floor(F.col("unit_id") / 4).cast("string"), F.lit("_p0")).alias("unit_id"), F.floor(F.col("unit_id") / 40).alias("qid")).agg(F.collect_list("v").alias("us"))
    q = v.where("unit_id % 20 = 0").groupBy(F.floor(F.col("unit_id") / 40).alias("qid")).agg(F.collect_list("v").alias("qs"))
    return dense.maxsim(docs.join(q, "qid"))


QUERIES = {f.__name__: f for f in (bm25_en_top10, bm25_vi_top10, bm25_zh_top10, bm25_k1b_variant, bm25_vocab_df, bm25_stats, bm25_weights, lsr_top10, dense_top10, dense_ivf_top10, dense_ivf_recall, dense_label_precision, maxsim_pairs)}

_EN = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"
_ANY = "regexp_extract_all(lower({}), '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}]|[\\p{{Latin}}\\p{{Greek}}\\p{{Cyrillic}}\\p{{N}}]+')"
_QT = "qt as (select id as qid, trim(lang) as lang, min(trim(query)) as query from queries where id is not null and query is not null and lang is not null and trim(query) <> '' group by 1, 2)"


def _units_sql(lang: str, tok: str, where: str = "") -> str:
    text = "case when coalesce(title, '') <> '' and text is not null then title || chr(10) || text when coalesce(title, '') <> '' then title else coalesce(text, '') end"
    return f"""with {_QT}, units as (select * from (select id || '_p0' as unit_id, {text} as text from corpus where lang = '{lang}') {where}),
tok as (select unit_id, {tok.format('text')} as t from units), dl as (select unit_id, len(t) as dl from tok),
tf as (select unit_id, term, least(count(*), 65535) as tf from (select unit_id, unnest(t) as term from tok) group by 1, 2),
df as (select term, count(*) as df from tf group by 1), st as (select count(*) as n, coalesce(sum(dl), 0) / greatest(1, count(*)) as avgdl from dl)
"""


def _bm25_sql(lang: str, tok: str, k1: float = bm25.K1, b: float = bm25.B) -> str:
    return _units_sql(lang, tok) + f""", q as (select qid, term, count(*) as qtf from (select qid, unnest({tok.format('query')}) as term from qt where lang = '{lang}') group by 1, 2),
s as (select qid, unit_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / ({k1} * ({1 - b} + {b} * dl / avgdl) + tf)), 9) as score
  from q join tf using (term) join df using (term) join dl using (unit_id) cross join st group by 1, 2 having score > 0)
select qid, unit_id, rank, score from (select *, row_number() over (partition by qid order by score desc, unit_id) as rank from s) where rank <= 10"""


_DOT = "list_dot_product(cast(x.embedding as double[]), cast(y.embedding as double[]))"
_DENSE = "with s as (select y.vec_id as qid, x.vec_id as unit_id, x.label, y.label as want, round(" + _DOT + ", 6) as score from embeddings x, embeddings y where y.vec_id % 20 = 0), r as (select *, row_number() over (partition by qid order by score desc, unit_id) as rank from s)\n"

SQL = {
    "bm25_en_top10": _bm25_sql("en", _EN), "bm25_vi_top10": _bm25_sql("vi", _ANY), "bm25_zh_top10": _bm25_sql("zh", _ANY), "bm25_k1b_variant": _bm25_sql("en", _EN, 0.9, 0.4),
    "bm25_vocab_df": _units_sql("en", _EN) + "select term, df from df", "bm25_stats": _units_sql("en", _EN) + "select n, round(avgdl, 6) as avgdl from st",
    "bm25_weights": _units_sql("en", _EN, "") + "select unit_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf), 6) as weight from tf join df using (term) join dl using (unit_id) cross join st",
    "lsr_top10": f"""with {_QT}, units as (select unit_id, min(text) as text from qrels where text is not null group by 1), tok as (select unit_id, {_ANY.format('text')} as t from units),
w as (select unit_id, term, count(*) / any_value(dl) as weight from (select unit_id, len(t) as dl, unnest(t) as term from tok) group by 1, 2),
q as (select qid, term, count(*) as qtf from (select qid, unnest({_ANY.format('query')}) as term from qt) group by 1, 2),
s as (select qid, unit_id, round(sum(qtf * weight), 9) as score from q join w using (term) group by 1, 2 having score > 0)
select qid, unit_id, rank, score from (select *, row_number() over (partition by qid order by score desc, unit_id) as rank from s) where rank <= 10""",
    "dense_top10": _DENSE + "select qid, unit_id, rank, score from r where rank <= 10",
    "dense_label_precision": _DENSE + "select qid, round(avg(case when label = want then 1.0 else 0.0 end), 6) as precision from r where rank <= 11 and qid <> unit_id group by 1",
    "maxsim_pairs": """with q as (select vec_id // 40 as qid, vec_id as qv, embedding from embeddings where vec_id % 20 = 0),
d as (select vec_id // 40 as qid, (vec_id // 4) || '_p0' as unit_id, embedding from embeddings),
m as (select q.qid, unit_id, qv, max(list_dot_product(cast(q.embedding as double[]), cast(d.embedding as double[]))) as best from q join d using (qid) group by all)
select qid, unit_id, round(avg(best), 6) as score from m group by all""",
}
