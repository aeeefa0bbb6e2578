"""Ranked lists: (branch, qid, unit_id, doc_id, rank, score) and the algebra over them.

Order is total everywhere: score descending, then the old rank where there is one, then unit_id by code point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(runs: DataFrame) -> DataFrame:
    """Lists as retrieval left them become proper runs: rows without a score or unit are dropped, a unit counts once with its best
    score, and ranks are given anew from 1."""
    best = runs.where("score is not null and not isnan(score) and unit_id is not null").groupBy("branch", "qid", "unit_id").agg(F.max("doc_id").alias("doc_id"), F.max(F.col("score").cast("double")).alias("score"))
    return by_score(best)


def by_score(df: DataFrame, depth: int | None = None, group: tuple[str, ...] = ("branch", "qid"), then: tuple[str, ...] = ()) -> DataFrame:
    """Re-number by score, ties by then and unit_id, and cut at depth."""
    w = Window.partitionBy(*group).orderBy(F.desc("score"), *then, "unit_id")
    out = df.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if depth is None else out.where(F.col("rank") <= depth)


def at_depth(runs: DataFrame, depth: int, qids: DataFrame | None = None) -> DataFrame:
    """Prefix of every list, of some queries only if qids is given (a frame with the column qid)."""
    out = runs.where(F.col("rank") <= depth)
    return out if qids is None else out.join(qids.select("qid").distinct(), "qid", "left_semi")


def parent_of(unit: str = "unit_id"):
    return F.regexp_replace(unit, r"_c\d+$", "")


def doc_of(unit: str = "unit_id"):
    return F.split_part(F.col(unit), F.lit("_"), F.lit(1))


def to_parents(runs: DataFrame) -> DataFrame:
    """Children become their parents; a parent keeps its best child's rank order and score."""
    p = runs.withColumn("unit_id", parent_of()).groupBy("branch", "qid", "unit_id", "doc_id").agg(F.min("rank").alias("best"), F.min_by("score", "rank").alias("score"))
    w = Window.partitionBy("branch", "qid").orderBy("best", "unit_id")
    return p.select("branch", "qid", "unit_id", "doc_id", F.row_number().over(w).cast("long").alias("rank"), "score")


def doc_ranking(runs: DataFrame) -> DataFrame:
    """(branch, qid, doc_id, rank): a document stands where its best unit does, numbered from 1."""
    best = runs.groupBy("branch", "qid", "doc_id").agg(F.min("rank").alias("best"))
    return best.select("branch", "qid", "doc_id", F.row_number().over(Window.partitionBy("branch", "qid").orderBy("best")).cast("long").alias("rank"))


def top_lists(runs: DataFrame, k: int, item: str = "unit_id") -> DataFrame:
    """(branch, qid, items): the first k items in order, as an array of at most k."""
    rows = runs.where(F.col("rank") <= k).groupBy("branch", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", item))).alias("x"))
    return rows.select("branch", "qid", F.transform("x", lambda s: s[item]).alias("items"))


def from_arrays(df: DataFrame) -> DataFrame:
    """Arrays of units and scores in order become rows with a rank."""
    x = df.select("branch", "qid", F.posexplode(F.arrays_zip("units", "scores")).alias("pos", "x"))
    return x.select("branch", "qid", F.col("x.units").alias("unit_id"), doc_of("x.units").cast("long").alias("doc_id"), (F.col("pos") + 1).cast("long").alias("rank"), F.col("x.scores").cast("double").alias("score"))


def with_tail(reranked: DataFrame, base: DataFrame, top_n: int) -> DataFrame:
    """A reranked block on top, then what the base list holds below top_n; ranks go on."""
    a = reranked.select("qid", "unit_id", "doc_id", F.lit(0).alias("part"), (-F.col("score")).alias("key"), F.col("rank").alias("old"))
    b = base.where(F.col("rank") > top_n).select("qid", "unit_id", "doc_id", F.lit(1).alias("part"), F.col("rank").cast("double").alias("key"), F.col("rank").alias("old"))
    w = Window.partitionBy("qid").orderBy("part", "key", "old", "unit_id")
    return a.unionByName(b).select("qid", "unit_id", "doc_id", "part", F.row_number().over(w).cast("long").alias("rank"))


def interleaved(runs: DataFrame, order: list[str], budget: int) -> DataFrame:
    """Round-robin union of branches with an exact budget: by rank, then branch; a unit counts at its first place."""
    rows = _numbered(runs, order)
    first = rows.groupBy("qid", "unit_id", "doc_id").agg(F.min(F.struct("rank", "no")).alias("at"))
    w = Window.partitionBy("qid").orderBy("at.rank", "at.no", "unit_id")
    return first.select("qid", "unit_id", "doc_id", F.row_number().over(w).cast("long").alias("rank")).where(F.col("rank") <= budget)


def _numbered(runs: DataFrame, order: list[str]) -> DataFrame:
    at = F.create_map(*(x for i, b in enumerate(order) for x in (F.lit(b), F.lit(i))))
    return runs.where(F.col("branch").isin(order)).withColumn("no", at[F.col("branch")].cast("long"))


def submission(run: DataFrame, texts: DataFrame, k_doc: int = 200, k_chunk: int = 185) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) to hand in: the first k_doc documents; the first k_chunk chunks without near-equal ones of a document
    (same lower-cased first 300 characters with spaces collapsed). run: (qid, unit_id, doc_id, rank)."""
    best = run.groupBy("qid", "doc_id").agg(F.min("rank").alias("best"))
    docs = best.select("qid", "doc_id", F.row_number().over(Window.partitionBy("qid").orderBy("best")).cast("long").alias("rank")).where(F.col("rank") <= k_doc)
    head = F.substring(F.lower(F.regexp_replace("text", r"[ \n\t\r]+", " ")), 1, 300)
    rows = run.join(texts.select("unit_id", "text"), "unit_id").withColumn("key", head)
    first = rows.groupBy("qid", "doc_id", "key").agg(F.min(F.struct("rank", "unit_id")).alias("x")).select("qid", "doc_id", "x.*")
    chunks = first.select("qid", "doc_id", "unit_id", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "unit_id")).cast("long").alias("rank")).where(F.col("rank") <= k_chunk)
    return docs, chunks


def violations(docs: DataFrame, chunks: DataFrame, qids: DataFrame, corpus: DataFrame) -> DataFrame:
    """(problem, qid, what) of a submission: queries missing, documents unknown, chunks empty."""
    missing = qids.select("qid").distinct().join(docs.select("qid").distinct(), "qid", "left_anti").select(F.lit("missing query").alias("problem"), "qid", F.lit("").alias("what"))
    unknown = docs.join(corpus.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select(F.lit("unknown document").alias("problem"), "qid", F.col("doc_id").cast("string").alias("what"))
    strange = docs.select("qid").distinct().join(qids.select("qid"), "qid", "left_anti").select(F.lit("unexpected query").alias("problem"), "qid", F.lit("").alias("what"))
    empty = chunks.where("unit_id is null or unit_id = ''").select(F.lit("empty chunk").alias("problem"), "qid", F.lit("").alias("what"))
    return missing.unionByName(unknown).unionByName(strange).unionByName(empty)
