"""From an attempt log to a corpus: best attempt per id, boilerplate, duplicates, titles, authors and keywords."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import bounded_join, discard, small_enough, written

BOILERPLATE_ROWS = 20


def state(attempts: DataFrame) -> DataFrame:
    """(id, done, attempts): whether an id needs no more work and how often it was tried."""
    s = F.col("status")
    return attempts.groupBy("id").agg(F.max(T.done(s)).alias("done"), F.sum(T.counts_as_attempt(s).cast("long")).alias("attempts"))


def todo(links: DataFrame, state_: DataFrame, most: int) -> DataFrame:
    """(id, url, attempts, gave_up) of the links that aren't done."""
    x = links.join(state_, "id", "left").where(~F.coalesce("done", F.lit(False)))
    n = F.coalesce("attempts", F.lit(0))
    return x.select("id", "url", n.alias("attempts"), (n >= most).alias("gave_up"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with _file and _row, which name a row of the files it is read from; other rows are written first."""
    try:
        rows.select("_metadata.row_index")
    except AnalysisException:
        rows = written(rows, "attempts")
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def winners(attempts: DataFrame, *tie: str) -> DataFrame:
    """The best row of every id with the number of its attempts: best status, then newest extraction, then latest processed, then tie, then the last of the files.

    Only the columns of the order and each row's place in its file are sorted and shuffled, cut to one row an id before the exchange; the winner's
    place brings the wide row back. Rows without an id are left out.
    """
    rows = _numbered(attempts)
    order = [T.status_rank(F.col("status")).asc(), F.coalesce("xv", F.lit(0)).desc(), F.coalesce("processed_at", F.lit("")).desc(), *(F.coalesce(F.col(t).cast("string"), F.lit("")).desc() for t in tie), F.desc("_file"), F.desc("_row")]
    best = rows.where("id is not null").select("id", "_file", "_row", F.row_number().over(Window.partitionBy("id").orderBy(*order)).alias("_r")).where("_r = 1")
    count = rows.where("id is not null").groupBy(F.col("id").alias("_id")).agg(F.count("*").cast("int").alias("attempts"))
    pick = written(best.join(count, best["id"] == count["_id"]).select("_file", "_row", "attempts"), "best")
    # beyond the size of a broadcast the wide rows are shuffled once, and not sorted
    pick = F.broadcast(pick) if small_enough(pick) else pick.hint("shuffle_hash")
    return rows.join(pick, ["_file", "_row"]).select(*attempts.columns, "attempts")


def boilerplate(win: DataFrame, least: int = BOILERPLATE_ROWS) -> DataFrame:
    """Status becomes boilerplate where a host has one text under least ids or more. Then the leader of each text's copies.

    Counts are aggregated before they meet the rows again, so a text that a third of all rows share is no hot partition.
    """
    s = F.col("status").isin("ok", "empty") & (F.coalesce("text_hash", F.lit("")) != "")
    many = win.where(s).groupBy("host", "text_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("host", "text_hash", F.lit(True).alias("_many"))
    many = written(many, "boilerplate")
    x = bounded_join(win, many, ["host", "text_hash"], "left").withColumn("status", F.when(s & F.col("_many"), "boilerplate").otherwise(F.col("status"))).drop("_many")
    lead = x.where(s).groupBy("text_hash").agg(F.min("id").alias("_lead"), F.count("*").alias("_c")).where("_c > 1").select("text_hash", "_lead")
    lead = written(lead, "leaders")
    x = bounded_join(x, lead, ["text_hash"], "left")
    return x.withColumn("dup_of", F.when(s & (F.col("_lead") != F.col("id")), F.col("_lead"))).drop("_lead")


def _contents(win: DataFrame) -> DataFrame:
    return win.where(F.col("status").isin("ok", "empty"))


def site_suffixes(win: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """(host, sep, tail, n): ends of titles that a host repeats, with the separator before them."""
    t = _contents(win).where("title <> ''").select("host", "title")
    n = t.groupBy("host").agg(F.count("*").alias("total"))
    seps = F.array(*(F.struct(F.lit(s).alias("sep"), F.when(F.contains("title", F.lit(s)), F.trim(T.after_last(F.col("title"), s))).alias("tail")) for s in T.TITLE_SEPARATORS))
    x = t.select("host", F.explode(seps).alias("x")).select("host", "x.sep", "x.tail").where("tail is not null and tail <> ''").groupBy("host", "sep", "tail").agg(F.count("*").alias("n"))
    return x.join(n, "host").where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("host", "sep", "tail", "n")


def _stripped(title: Column, ends: Column) -> Column:
    """Title after two passes over the ends, the longest first."""
    cut = lambda t, e: F.when(F.endswith(t, e) & (F.length(t) > F.length(e)), F.trim(F.left(t, F.length(t) - F.length(e)))).otherwise(t)
    once = F.aggregate(ends, title, cut)
    return F.aggregate(ends, once, cut)


def clean_titles(win: DataFrame) -> DataFrame:
    """title_new without the host's suffixes; blank and flagged generic where a host repeats it or it is the site's name."""
    suf = written(site_suffixes(win), "suffixes")
    # a host has few suffixes: each covers a share of its titles under one of 13 separators
    ends = suf.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.length(F.concat("sep", "tail"))).alias("n"), F.concat("sep", "tail").alias("e")))).alias("x"), F.collect_set("tail").alias("_tails"))
    ends = written(ends.select("host", F.transform("x", lambda s: s["e"]).alias("_ends"), "_tails"), "ends")
    x = bounded_join(win, ends, ["host"], "left")
    body = F.col("status").isin("ok", "empty")
    t = F.coalesce("title", F.lit(""))
    x = x.withColumn("title_new", F.when(body & F.col("_ends").isNotNull(), _stripped(t, F.col("_ends"))).otherwise(t))
    n = _contents(x).groupBy("host").agg(F.count("*").alias("_rows"))
    often = _contents(x).where("title_new <> ''").groupBy("host", "title_new").agg(F.count("*").alias("_n")).join(n, "host").where((F.col("_n") >= 50) & (F.col("_n") >= 0.05 * F.col("_rows")))
    names = _contents(x).where("site_name is not null").select("host", F.col("site_name").alias("title_new")).distinct()
    generic = often.select("host", "title_new").union(names).union(suf.select("host", F.col("tail").alias("title_new"))).distinct().withColumn("_generic", F.lit(True))
    generic = written(generic, "generic")
    x = bounded_join(x, generic, ["host", "title_new"], "left").withColumn("generic", body & (F.col("title_new") != "") & F.coalesce("_generic", F.lit(False)))
    return x.withColumn("title_new", F.when(F.col("generic"), "").otherwise(F.col("title_new"))).drop("_ends", "_tails", "_generic")


def default_authors(win: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """(host, author, n): authors that stand under so much of a host that they mean the host."""
    n = _contents(win).groupBy("host").agg(F.count("*").alias("total"))
    a = _contents(win).where("author <> ''").groupBy("host", "author").agg(F.count("*").alias("n"))
    return a.join(n, "host").where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("host", "author", "n")


def common_keywords(win: DataFrame, least: int = 20, share: float = 0.3) -> DataFrame:
    """(host, keyword, n): keywords that so many of a host's documents have that they say nothing."""
    n = _contents(win).groupBy("host").agg(F.count("*").alias("total"))
    k = _contents(win).select("host", F.explode(F.array_distinct(F.split(F.coalesce("keywords", F.lit("")), "; "))).alias("keyword")).where("keyword <> ''").groupBy("host", "keyword").agg(F.count("*").alias("n"))
    return k.join(n, "host").where((F.col("n") >= least) & (F.col("n") >= share * F.col("total"))).select("host", "keyword", "n")


def corpus(attempts: DataFrame, include_short: bool = True) -> DataFrame:
    """The whole merge: one row per id that has content, with dup_of, flags, attempts and cleaned title, author and keywords."""
    best = written(winners(attempts, "fetched_at", "session"), "winners")  # each statistic reads its own columns of it
    win = written(clean_titles(boilerplate(best)), "marked")
    discard(best)
    au = written(default_authors(win).select("host", "author", F.lit(True).alias("_default")), "authors")
    kw = written(common_keywords(win).groupBy("host").agg(F.collect_set("keyword").alias("_common")), "keywords")
    body = F.col("status").isin("ok", "empty")
    x = bounded_join(bounded_join(win, au, ["host", "author"], "left"), kw, ["host"], "left")
    words = F.filter(F.split(F.coalesce("keywords", F.lit("")), "; "), lambda k: (k != "") & ~F.coalesce(F.array_contains("_common", k), F.lit(False)))
    flags = F.array_compact(F.array(F.when(F.col("dup_of").isNotNull(), "dup"), F.when(F.col("generic"), "generic_title"), F.when(F.col("status") == "empty", "short")))
    x = x.withColumns({
        "author": F.when(body & F.coalesce("_default", F.lit(False)), "").otherwise(F.coalesce("author", F.lit(""))), "keywords": F.when(body & F.col("_common").isNotNull(), F.array_join(words, "; ")).otherwise(F.coalesce("keywords", F.lit(""))),
        "flags": F.array_join(flags, ","), "title": F.col("title_new"),
    })
    keep = (F.col("status") == "ok") | (F.lit(include_short) & (F.col("status") == "empty") & (F.col("title") != ""))
    return x.where(keep).select(*attempts.columns, "dup_of", "flags", "attempts")
