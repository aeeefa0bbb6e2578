"""Tables about hosts, languages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

KINDS = ("ok", "short", "notice", "gone", "error", "pending")


def with_pending(win: DataFrame, links: DataFrame) -> DataFrame:
    """(id, host, status, n_chars, lang, published, author) of the winners and of the links that have no row yet."""
    cols = ["id", "host", "status", "n_chars", "lang", "published", "author"]
    miss = links.join(win.select("id"), "id", "left_anti").select("id", T.host_of(F.col("url")).alias("host"), F.lit("pending").alias("status"))
    return win.select(*cols).unionByName(miss, allowMissingColumns=True)


def host_table(win: DataFrame) -> DataFrame:
    """One row per host: counts by kind, share of ok, median length, shares with date and author, the three commonest errors."""
    w = win.withColumn("kind", T.host_kind(F.col("status")))
    ok = F.col("kind") == "ok"
    has = lambda c: F.when(ok, (F.coalesce(c, F.lit("")) != "").cast("double"))
    t = w.groupBy("host").agg(
        F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k) for k in KINDS), F.round(100 * F.count_if(ok) / F.count("*"), 1).alias("ok_pct"),
        F.coalesce(F.floor(F.median(F.when(ok, F.col("n_chars")))), F.lit(0)).cast("long").alias("median_chars"),
        F.coalesce(F.round(100 * F.avg(has("published")), 0), F.lit(0.0)).alias("pct_date"), F.coalesce(F.round(100 * F.avg(has("author")), 0), F.lit(0.0)).alias("pct_author"),
    )
    e = w.where("kind = 'error'").groupBy("host", F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))
    top = e.withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "status"))).where("r <= 3")
    top = top.groupBy("host").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(":", "status", "n").alias("s")))), lambda x: x["s"]), ", ").alias("top_errors"))
    return t.join(top, "host", "left").withColumn("top_errors", F.coalesce("top_errors", F.lit("")))


def totals(table: DataFrame) -> DataFrame:
    return table.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("total", *KINDS)))


def status_counts(attempts: DataFrame) -> DataFrame:
    """(host, status, n) and (status, n) at once; host is null in the latter and by_host tells them apart."""
    x = attempts.groupingSets([[F.col("host"), F.col("status")], [F.col("status")]], F.col("host"), F.col("status"))
    return x.agg(F.count("*").alias("n"), (F.grouping("host") == 0).alias("by_host"))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """(what, value, n): documents by language, type and status, and duplicates."""
    x = corpus.select(F.explode(F.array(
        F.struct(F.lit("lang").alias("what"), F.coalesce("lang", F.lit("")).alias("value")), F.struct(F.lit("doc_type").alias("what"), F.coalesce("doc_type", F.lit("")).alias("value")),
        F.struct(F.lit("status").alias("what"), F.coalesce("status", F.lit("")).alias("value")), F.struct(F.lit("dup").alias("what"), F.when(F.col("dup_of").isNotNull(), "yes").otherwise("no").alias("value")),
    )).alias("x"))
    return x.groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def lang_summary(win: DataFrame) -> DataFrame:
    """(lang, n, median) of the documents that are ok."""
    return win.where("status = 'ok'").groupBy("lang").agg(F.count("*").alias("n"), F.median("n_chars").alias("median"))


def size_percentiles(df: DataFrame, size: str, *keys: str, least: int = 1) -> DataFrame:
    """Percentiles of a size by keys, for groups of least rows and more."""
    ps = (5, 25, 50, 75, 95)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(size, [p / 100 for p in ps]).alias("p")).where(F.col("n") >= least)
    return g.select(*keys, "n", *(F.round(F.col("p")[i], 6).alias(f"p{p}") for i, p in enumerate(ps)))
