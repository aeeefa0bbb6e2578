"""Choosing queries to judge, pooling, sheets, agreement and qrels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import places


def tertile(n_rows: str, place: str):
    """0, 1 or 2 by linear quantiles of the places 1..n, as quantile cuts do (not equal to ntile)."""
    return F.when(F.col(n_rows) <= 1, 0).otherwise(F.least(F.lit(2), F.floor((F.col(place) - 1) * 3 / (F.col(n_rows) - 1)))).cast("long")


def strata(queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(qid, len, disagree, len_bin, dis_bin): tertiles of the query's length and of the branches' mean disagreement.

    queries (qid, query), one row a query; pairs as diag.pairwise gives them. The places are ranks over all queries, computed in ranges of values where there are very many.
    """
    j = pairs.groupBy("qid").agg(F.avg("jaccard").alias("j"))
    x = queries.join(j, "qid", "left").select("qid", F.length("query").cast("long").alias("len"), F.round(1 - F.coalesce("j", F.lit(0.0)), 6).alias("disagree"))
    x = x.withColumns({"_all": F.lit(0), "_l": -F.col("len"), "_d": -F.col("disagree")})
    x = places(x, ["_all"], "_l", ["qid"]).withColumnRenamed("place", "a")
    x = places(x, ["_all"], "_d", ["qid"]).withColumnRenamed("place", "b").crossJoin(F.broadcast(queries.agg(F.count("*").alias("n"))))
    return x.select("qid", "len", "disagree", tertile("n", "a").alias("len_bin"), tertile("n", "b").alias("dis_bin"))


def select(strata_: DataFrame, n: int, pilot: int, seed: str = "13") -> DataFrame:
    """(qid, set): as many from each of the nine strata, the rest at random (order of an md5 of the id), the first pilot as pilot."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("qid").cast("string")))
    x = strata_.select("qid", h.alias("h"), F.row_number().over(Window.partitionBy("len_bin", "dis_bin").orderBy(h)).alias("r"))
    x = x.withColumn("late", (F.col("r") > max(1, n // 9)).cast("int")).orderBy("late", "h").limit(n)  # n rows from here on
    k = F.row_number().over(Window.orderBy("late", "h"))
    return x.select("qid", k.alias("k")).select("qid", F.when(F.col("k") <= pilot, "pilot").otherwise("main").alias("set"))


def pool(runs: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """(qid, unit_id, doc_id, src): units of the runs' prefixes with where they came from, 'run@rank;...' in the order of specs."""
    s = runs.sparkSession.createDataFrame([(b, d, i) for i, (b, d) in enumerate(specs)], "branch string, depth int, no int")
    x = runs.join(F.broadcast(s), "branch").where("rank <= depth")
    g = x.groupBy("qid", "unit_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("no", F.concat_ws("@", "branch", "rank").alias("s")))).alias("x"))  # one entry a run
    return g.select("qid", "unit_id", "doc_id", F.array_join(F.transform("x", lambda s: s["s"]), ";").alias("src"))


def extension(pool_: DataFrame, known: DataFrame) -> DataFrame:
    """Items of a pool that aren't judged yet."""
    return pool_.join(known.select("qid", "unit_id").distinct(), ["qid", "unit_id"], "left_anti")


def sheets(items: DataFrame, labelers: list[str], overlap: float, salt: str = "13") -> DataFrame:
    """(labeler, item, qid, unit_id): queries go round the labelers; the first share of overlap also to the next one, or to all if 1 or more."""
    n = len(labelers)
    q = items.select("qid").distinct()
    q = q.withColumn("h", F.md5(F.concat_ws(":", F.lit(salt), F.col("qid").cast("string")))).withColumn("part", F.left("h", F.lit(2)))
    # places in the order of h, within each of 256 parts of it and then from the sizes of the parts before
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = q.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    q = q.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("h"))).join(F.broadcast(sizes), "part")
    q = q.select("qid", (F.col("before") + F.col("r") - 1).alias("i")).crossJoin(F.broadcast(q.agg(F.count("*").alias("n"))))
    dup = F.col("i") < F.round(F.lit(min(overlap, 1.0)) * F.col("n"))
    first = F.col("i") % n
    who = F.when(dup, F.sequence(F.lit(0), F.lit(n - 1)) if overlap >= 1 else F.array_distinct(F.array(first, (first + 1) % n))).otherwise(F.array(first))
    names = F.array(*map(F.lit, labelers))
    x = q.select("qid", F.explode(who).alias("k")).select("qid", F.element_at(names, F.col("k").cast("int") + 1).alias("labeler"))
    return items.join(x, "qid").select("labeler", T.code(F.col("qid"), F.col("unit_id"), salt).alias("item"), "qid", "unit_id")


def one_each(labels: DataFrame) -> DataFrame:
    """(item, labeler, tag, grade): valid grades, one per item and labeler; of several sheets the last by tag counts."""
    ok = labels.where(F.col("grade").isin(0, 1, 2) & F.col("item").isNotNull() & F.col("labeler").isNotNull())
    return ok.groupBy("item", "labeler").agg(F.max(F.struct(F.coalesce("tag", F.lit("")).alias("tag"), (-F.col("grade")).alias("g"))).alias("x")).select("item", "labeler", "x.tag", (-F.col("x.g")).cast("long").alias("grade"))


def rater_pairs(labels: DataFrame) -> DataFrame:
    """(item, tag, a, b): grades of every two labelers of an item, counted per pair of grades by the caller.

    Within an item grades are first counted, so that an item with very many labelers gives nine rows and not all pairs.
    """
    tag = labels.groupBy("item").agg(F.max("tag").alias("tag"))
    c = labels.groupBy("item", "grade").agg(F.count("*").alias("c"))
    x = c.select("item", F.col("grade").alias("a"), F.col("c").alias("ca")).join(c.select("item", F.col("grade").alias("b"), F.col("c").alias("cb")), "item").where("a <= b")
    n = F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb"))
    return x.select("item", "a", "b", n.cast("long").alias("n")).where("n > 0").join(tag, "item")


def agreement(labels: DataFrame) -> DataFrame:
    """(tag, pairs, same, kappa, kappa2): share of equal grades and Cohen's kappa on three levels and on relevant or not, per tag and
    overall (tag null). Pairs have no order, so each counts half in either; kappa is 1 where chance agreement is."""
    p = rater_pairs(labels)
    p = p.unionByName(p.withColumn("tag", F.lit(None).cast("string")))
    both = p.select("tag", "a", "b", "n").union(p.select("tag", "b", "a", "n"))

    def kappa(x: DataFrame, name: str) -> DataFrame:
        t = x.groupBy("tag").agg(F.sum("n").alias("t"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"))
        m = x.groupBy("tag", "a").agg(F.sum("n").alias("m")).join(t.select("tag", "t").withColumnRenamed("tag", "tt"), F.col("tag").eqNullSafe(F.col("tt"))).groupBy("tag").agg(F.sum((F.col("m") / F.col("t")) * (F.col("m") / F.col("t"))).alias("pe")).withColumnRenamed("tag", "mt")
        return t.join(m, F.col("tag").eqNullSafe(F.col("mt"))).select("tag", (F.col("t") / 2).cast("long").alias("pairs"), F.round("po", 6).alias("same"), F.round(F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).otherwise(1.0), 6).alias(name))

    three = kappa(both, "kappa")
    two = kappa(both.select("tag", (F.col("a") >= 1).alias("a"), (F.col("b") >= 1).alias("b"), "n"), "kappa2").select(F.col("tag").alias("t2"), "kappa2")
    return three.join(two, F.col("tag").eqNullSafe(F.col("t2"))).drop("t2")


def disagreements(labels: DataFrame, key: DataFrame) -> DataFrame:
    """(item, qid, unit_id, g_min, g_max, n) of the items whose grades differ."""
    g = labels.groupBy("item").agg(F.min("grade").alias("g_min"), F.max("grade").alias("g_max"), F.count("*").alias("n")).where("g_min < g_max")
    return g.join(key.select("item", "qid", "unit_id").distinct(), "item").select("item", "qid", "unit_id", "g_min", "g_max", "n")


def qrels(labels: DataFrame, key: DataFrame, adjudicated: DataFrame | None = None) -> DataFrame:
    """(qid, unit_id, doc_id, grade, n_labelers): the lowest grade of an item unless it was adjudicated."""
    g = labels.groupBy("item").agg(F.min("grade").alias("grade"), F.count("*").alias("n_labelers"))
    if adjudicated is not None:
        g = g.join(adjudicated.select("item", F.col("grade").alias("adj")), "item", "left").withColumn("grade", F.coalesce("adj", "grade")).drop("adj")
    return g.join(key.select("item", "qid", "unit_id", "doc_id").distinct(), "item").select("qid", "unit_id", "doc_id", "grade", "n_labelers")


def per_query(qrels_: DataFrame) -> DataFrame:
    return qrels_.groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.col("grade") >= 1).alias("rel"), F.count_if(F.col("grade") >= 2).alias("rel2"))


def by_labeler(labels: DataFrame, labelers: list[str]) -> DataFrame:
    """item x labeler: the lowest grade."""
    return labels.groupBy("item").pivot("labeler", labelers).agg(F.min("grade"))
