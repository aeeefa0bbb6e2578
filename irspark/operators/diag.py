"""Label-free diagnostics of branches and fused lists. Lists are (branch, qid, item, rank) cut at k by the caller's choice of k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fusion


def _lists(runs: DataFrame, item: str, k: int) -> DataFrame:
    return runs.where(F.col("rank") <= k).select("branch", "qid", F.col(item).alias("item"), "rank")


def pairwise(runs: DataFrame, item: str, k: int, p: float = 0.9) -> DataFrame:
    """Per pair of branches and query: Jaccard, overlap coefficient and rank-biased overlap (truncated at the shorter list)."""
    x = _lists(runs, item, k)
    n = x.groupBy("branch", "qid").agg(F.count("*").alias("n"))
    pairs = n.select(F.col("branch").alias("a"), "qid", F.col("n").alias("na")).join(n.select(F.col("branch").alias("b"), "qid", F.col("n").alias("nb")), "qid").where("a < b")
    common = x.select(F.col("branch").alias("a"), "qid", "item", F.col("rank").alias("ra")).join(x.select(F.col("branch").alias("b"), "qid", "item", F.col("rank").alias("rb")), ["qid", "item"]).where("a < b")
    common = common.select("a", "b", "qid", F.greatest("ra", "rb").alias("m"))
    c = common.groupBy("a", "b", "qid").agg(F.count("*").alias("c"))
    # a common item enters the overlap at the deeper of its two ranks and counts at all depths from there
    size = pairs.withColumn("d", F.least("na", "nb"))
    at = common.join(size.select("a", "b", "qid", "d"), ["a", "b", "qid"]).where("m <= d")
    terms = at.select("a", "b", "qid", F.explode(F.sequence("m", "d")).alias("depth")).groupBy("a", "b", "qid").agg(F.sum(F.pow(F.lit(p), F.col("depth") - 1) / F.col("depth")).alias("s"))
    out = pairs.join(c, ["a", "b", "qid"], "left").join(terms, ["a", "b", "qid"], "left")
    c0 = F.coalesce("c", F.lit(0))
    return out.select("a", "b", "qid", F.round(c0 / (F.col("na") + F.col("nb") - c0), 6).alias("jaccard"), F.round(c0 / F.least("na", "nb"), 6).alias("overlap"), F.round((1 - p) * F.coalesce("s", F.lit(0.0)), 9).alias("rbo"))


def pair_means(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_q"), *(F.round(F.avg(c), 9).alias(c) for c in ("jaccard", "overlap", "rbo")))


def exclusive(runs: DataFrame, item: str, k: int) -> DataFrame:
    """(branch, mean): items that no other branch has in its top k, averaged over the branch's own queries."""
    x = _lists(runs, item, k)
    one = x.groupBy("qid", "item").agg(F.count("*").alias("n"), F.min("branch").alias("branch")).where("n = 1")
    per = one.groupBy("branch", "qid").agg(F.count("*").alias("n"))
    own = x.select("branch", "qid").distinct()
    return own.join(per, ["branch", "qid"], "left").groupBy("branch").agg(F.round(F.avg(F.coalesce("n", F.lit(0))), 6).alias("mean"))


def union_growth(runs: DataFrame, item: str, order: list[str], k: int) -> DataFrame:
    """(step, branch, new_mean, union_mean): what each branch adds to those before it, averaged over all queries seen."""
    at = F.create_map(*(x for i, b in enumerate(order) for x in (F.lit(b), F.lit(i))))
    x = _lists(runs.where(F.col("branch").isin(order)), item, k).withColumn("step", at[F.col("branch")])
    first = x.groupBy("qid", "item").agg(F.min("step").alias("step")).groupBy("step").agg(F.count("*").alias("n"))
    nq = x.select("qid").distinct().count()
    steps = runs.sparkSession.createDataFrame([(i, b) for i, b in enumerate(order)], "step int, branch string")
    new = F.coalesce("n", F.lit(0)) / F.lit(max(nq, 1))
    w = Window.orderBy("step")  # one row for each branch
    return steps.join(first, "step", "left").select(F.col("step").cast("long").alias("step"), "branch", F.round(new, 6).alias("new_mean"), F.round(F.sum(new).over(w), 6).alias("union_mean"))


def greedy_order(runs: DataFrame, item: str, names: list[str], k: int) -> list[str]:
    """Branches in the order in which each adds most new items. One aggregate a step; the items' branch sets are bit masks."""
    bit = F.create_map(*(x for i, b in enumerate(names) for x in (F.lit(b), F.lit(1 << i))))
    masks = _lists(runs.where(F.col("branch").isin(names)), item, k).groupBy("qid", "item").agg(F.bit_or(bit[F.col("branch")]).alias("m")).groupBy("m").agg(F.count("*").alias("n"))
    table = [(r["m"], r["n"]) for r in masks.collect()]  # 2^branches rows at most
    out, have = [], 0
    while len(out) < len(names):
        gain = {b: sum(n for m, n in table if m >> i & 1 and not m & have) for i, b in enumerate(names) if b not in out}
        best = max(gain, key=lambda b: gain[b])
        out.append(best)
        have |= 1 << names.index(best)
    return out


def lang_profile(runs: DataFrame, langs: DataFrame, k: int) -> DataFrame:
    """(branch, lang, share) of the documents in the top k; languages other than vi, en, zh count as ?."""
    x = _lists(runs, "doc_id", k).join(langs.select(F.col("doc_id").alias("item"), "lang"), "item", "left")
    lang = F.when(F.col("lang").isin("vi", "en", "zh"), F.col("lang")).otherwise("?")
    n = x.groupBy("branch", lang.alias("lang")).agg(F.count("*").alias("n"))
    return n.select("branch", "lang", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("branch")), 6).alias("share"))


def composition(fused: DataFrame, runs: DataFrame, k: int, depth: int) -> DataFrame:
    """(support, n, sole_branch): for the fused top k, how many branches hold each unit in their top depth, and which if only one."""
    top = fused.where(F.col("rank") <= k).select("qid", F.col("unit_id").alias("item"))
    x = top.join(_lists(runs, "unit_id", depth), ["qid", "item"], "left").groupBy("qid", "item").agg(F.count("branch").alias("support"), F.min("branch").alias("one"))
    return x.groupBy("support", F.when(F.col("support") == 1, F.col("one")).alias("sole_branch")).agg(F.count("*").alias("n"))


def leave_one_out(spark: SparkSession, runs: DataFrame, names: list[str], depth: int, k: int) -> DataFrame:
    """(removed, jaccard): overlap of the fused top k with and without each branch; all variants are fused at once."""
    cfg = fusion.config(spark, {"": names} | {b: [x for x in names if x != b] for b in names})
    f = fusion.rrf(runs, cfg, depth, cut=k).select("config", "qid", "unit_id")
    full, part = f.where("config = ''"), f.where("config <> ''")
    nf = full.groupBy("qid").agg(F.count("*").alias("nf"))
    np_ = part.groupBy("config", "qid").agg(F.count("*").alias("np"))
    c = part.join(full.select("qid", "unit_id"), ["qid", "unit_id"]).groupBy("config", "qid").agg(F.count("*").alias("c"))
    removed = spark.createDataFrame([(b,) for b in names], "config string")
    x = nf.crossJoin(F.broadcast(removed)).join(np_, ["config", "qid"], "left").join(c, ["config", "qid"], "left")
    c0 = F.coalesce("c", F.lit(0))
    return x.select(F.col("config").alias("removed"), (c0 / (F.col("nf") + F.coalesce("np", F.lit(0)) - c0)).alias("j")).groupBy("removed").agg(F.round(F.avg("j"), 6).alias("jaccard"))


def k_sensitivity(spark: SparkSession, runs: DataFrame, names: list[str], depth: int, k: int, values: tuple[int, ...] = (10, 30, 100)) -> DataFrame:
    """(k, kept): share of the fused top k that other constants keep."""
    ks = spark.createDataFrame([(v,) for v in (fusion.RRF_K, *values)], "k int")
    f = fusion.rrf(runs, fusion.config(spark, {"all": names}), depth, ks, cut=k).select("k", "qid", "unit_id")
    base = f.where(F.col("k") == fusion.RRF_K).drop("k")
    n = base.groupBy("qid").agg(F.count("*").alias("n"))
    c = f.where(F.col("k") != fusion.RRF_K).join(base, ["qid", "unit_id"]).groupBy("k", "qid").agg(F.count("*").alias("c"))
    other = spark.createDataFrame([(v,) for v in values], "k int")
    x = n.crossJoin(F.broadcast(other)).join(c, ["k", "qid"], "left")
    return x.groupBy(F.col("k").cast("long").alias("k")).agg(F.round(F.avg(F.coalesce("c", F.lit(0)) / F.col("n")), 6).alias("kept"))


def rerank_change(before: DataFrame, after: DataFrame, k: int) -> DataFrame:
    """(qid, jaccard, tau): of the two top k's; tau over the common units if there are three at least. Ranks have no ties."""
    a, b = before.where(F.col("rank") <= k).select("qid", "unit_id", F.col("rank").alias("ra")), after.where(F.col("rank") <= k).select("qid", "unit_id", F.col("rank").alias("rb"))
    n = a.groupBy("qid").agg(F.count("*").alias("na")).join(b.groupBy("qid").agg(F.count("*").alias("nb")), "qid")
    common = a.join(b, ["qid", "unit_id"])
    c = common.groupBy("qid").agg(F.count("*").alias("c"))
    # k is small: within a query at most k rows meet k rows
    pairs = common.select("qid", F.col("ra").alias("x1"), F.col("rb").alias("y1")).join(common.select("qid", F.col("ra").alias("x2"), F.col("rb").alias("y2")), "qid").where("x1 < x2")
    s = pairs.groupBy("qid").agg(F.sum(F.when(F.col("y1") < F.col("y2"), 1).otherwise(-1)).alias("s"))
    out = n.join(c, "qid", "left").join(s, "qid", "left")
    c0 = F.coalesce("c", F.lit(0))
    return out.select("qid", F.round(c0 / (F.col("na") + F.col("nb") - c0), 6).alias("jaccard"), F.when(c0 >= 3, F.round(F.col("s") / (c0 * (c0 - 1) / 2), 6)).alias("tau"))
