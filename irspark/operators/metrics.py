"""Ranking metrics against judged pools, and their uncertainty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import lcs_length, unit_words

RELEVANT = 1
LCS_SHARE = 0.4


def f2(p: Column, r: Column) -> Column:
    """F-measure with beta 2; 0 if both are 0."""
    return F.when(p + r > 0, 5 * p * r / (4 * p + r)).otherwise(0.0)


def judged(qrels: DataFrame) -> DataFrame:
    """(qid, unit_id, doc_id, grade): one grade a unit, the highest if rows disagree; null grades are no judgements."""
    return qrels.where("grade is not null and qid is not null and unit_id is not null").groupBy("qid", "unit_id").agg(F.max("doc_id").alias("doc_id"), F.max("grade").cast("long").alias("grade"))


def doc_metrics(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...], threshold: int = RELEVANT) -> DataFrame:
    """(branch, qid, k, p, pj, r, f2, judged) over documents for every judged query and branch.

    run: (branch, qid, doc_id, rank). Precision divides by what was returned. Queries without relevant documents have null r and f2;
    judged queries that a run doesn't answer have precision 0.
    """
    docs = judged(qrels).groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"))
    n_rel = docs.groupBy("qid").agg(F.sum((F.col("grade") >= threshold).cast("long")).alias("n_rel"))
    base = n_rel.join(F.broadcast(run.select("branch").distinct()), how="cross")  # a few branches
    grid = base.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))))
    x = run.where(F.col("rank") <= max(ks)).join(docs, ["qid", "doc_id"], "left").join(n_rel.select("qid"), "qid", "left_semi")
    x = x.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks)))).where("rank <= k")
    s = x.groupBy("branch", "qid", "k").agg(F.count("*").alias("n"), F.count("grade").alias("nj"), F.sum(F.when(F.col("grade") >= threshold, 1).otherwise(0)).alias("tp"))
    s = grid.join(s, ["branch", "qid", "k"], "left").fillna(0, ["n", "nj", "tp"])
    p = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("n_rel") > 0, F.col("tp") / F.col("n_rel"))
    return s.select(
        "branch", "qid", "k", F.round(p, 6).alias("p"), F.round(F.when(F.col("nj") > 0, F.col("tp") / F.col("nj")), 6).alias("pj"), F.round(r, 6).alias("r"),
        F.round(F.when(F.col("n_rel") > 0, f2(p, r)), 6).alias("f2"), F.round(F.when(F.col("n") > 0, F.col("nj") / F.col("n")), 6).alias("judged"),
    )


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(branch, qid, ndcg): gain is the grade, discount log2(rank + 1), the ideal from the judged grades; null without an ideal."""
    j = judged(qrels)
    w = Window.partitionBy("qid").orderBy(F.desc("grade"), "unit_id")
    ideal = j.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("qid").agg(F.sum(F.col("grade") / F.log2(F.col("i") + 1)).alias("idcg"))
    got = run.where(F.col("rank") <= k).join(j.select("qid", "unit_id", "grade"), ["qid", "unit_id"]).groupBy("branch", "qid").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"))
    grid = ideal.join(F.broadcast(run.select("branch").distinct()), how="cross")
    x = grid.join(got, ["branch", "qid"], "left")
    return x.select("branch", "qid", F.round(F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")), 6).alias("ndcg"))


def unit_hits(run: DataFrame, texts: DataFrame, qrels: DataFrame, threshold: int = RELEVANT, share: float = LCS_SHARE) -> DataFrame:
    """(branch, qid, unit_id, rank, gold): returned units that match a relevant one: the same unit, or one of the same document
    that holds enough of its words in order. texts: (unit_id, text). A cheap bound on the words goes before the exact length.
    """
    gold = qrels.where((F.col("grade") >= threshold) & F.col("text").isNotNull()).groupBy("qid", F.col("unit_id").alias("gold"), "doc_id").agg(F.max("text").alias("gold_text"))
    pairs = run.join(gold, ["qid", "doc_id"])
    same = pairs.where("unit_id = gold").select("branch", "qid", "unit_id", "rank", "gold")
    other = pairs.where("unit_id <> gold").join(texts.select("unit_id", "text"), "unit_id")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for t, g in zip(b["text"], b["gold_text"]):
                got, want = unit_words(t), unit_words(g)
                n = max(1, len(want))
                have = set(got)
                keep.append(sum(x in have for x in want) / n >= share and lcs_length(got, want) / n >= share)
            yield b.loc[keep, ["branch", "qid", "unit_id", "rank", "gold"]]

    return same.unionByName(other.select("branch", "qid", "unit_id", "rank", "gold", "text", "gold_text").mapInPandas(match, same.schema))


def unit_metrics(run: DataFrame, hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...], threshold: int = RELEVANT) -> DataFrame:
    """(branch, qid, k, p, r, f2) over units: returned units with a hit, relevant units that were hit."""
    n_rel = judged(qrels).groupBy("qid").agg(F.sum((F.col("grade") >= threshold).cast("long")).alias("n_rel"))
    grid = n_rel.join(F.broadcast(run.select("branch").distinct()), how="cross").withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))))
    at = lambda x: x.withColumn("k", F.explode(F.array(*(F.lit(k).cast("long") for k in ks)))).where("rank <= k")
    n = at(run.where(F.col("rank") <= max(ks))).groupBy("branch", "qid", "k").agg(F.count("*").alias("n"))
    h = at(hits).groupBy("branch", "qid", "k").agg(F.countDistinct("unit_id").alias("ok"), F.countDistinct("gold").alias("found"))
    x = grid.join(n, ["branch", "qid", "k"], "left").join(h, ["branch", "qid", "k"], "left").fillna(0, ["n", "ok", "found"])
    p, r = F.when(F.col("n") > 0, F.col("ok") / F.col("n")).otherwise(0.0), F.when(F.col("n_rel") > 0, F.col("found") / F.col("n_rel"))
    return x.select("branch", "qid", "k", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(F.when(F.col("n_rel") > 0, f2(p, r)), 6).alias("f2"))


def macro(per_query: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over the queries for which a value is defined."""
    return per_query.groupBy(*keys).agg(*(F.round(F.avg(v), 9).alias(v) for v in values), F.count("*").alias("n_q"))


#: Resamplings, and bounds of a uniform number below which a case counts 0, 1, 2, ... times (Poisson with mean 1).
ROUNDS = 1000
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406, 0.999917)
_PRIME = 2147483647


def drawn(unit: Column, round_: Column, seed: int = 0) -> Column:
    """A number below _PRIME that looks random and depends on nothing but the case, the round and the seed."""
    x = (F.pmod(unit, F.lit(_PRIME)) * 7919 + round_ * 104729 + 15485863 * (seed + 1)) % _PRIME
    for add in (12345, 67891, 424243):
        x = (x * x + add) % _PRIME
    return x


def times(draw: Column) -> Column:
    """How often a case counts in a round."""
    u = draw / float(_PRIME)
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out


def _rounds(cases: DataFrame, n: int) -> DataFrame:
    return cases.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def intervals(per_query: DataFrame, keys: list[str], values: list[str], rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """(keys, metric, n, mean, low, high): bootstrap intervals of 95 %. In each round a query counts as often as a Poisson number says that is drawn by its id, so that
    rounds are sums, aggregated before the exchange, and no group is gathered. A round without any case says nothing."""
    long = per_query.unpivot(["qid", *keys], values, "metric", "value").where("value is not null")
    keys = [*keys, "metric"]
    x = _rounds(long, rounds).withColumn("w", times(drawn(F.col("qid"), F.col("round"), seed)))
    m = x.groupBy(*keys, "round").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    q = m.groupBy(*keys).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return whole.join(q, keys).select(*keys, "n", F.round("mean", 9).alias("mean"), F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"))


def paired(per_query: DataFrame, value: str, base: str, rounds: int = 2 * ROUNDS, seed: int = 0) -> DataFrame:
    """(branch, n, diff, low, high, p): every branch against base over the queries both have: bootstrap interval of the mean
    difference and a two-sided sign-flip test, both by sums over rounds as in intervals()."""
    b = per_query.where(F.col("branch") == base).select("qid", F.col(value).alias("_base"))
    d = per_query.where(F.col("branch") != base).join(b, "qid").select("branch", "qid", (F.col(value) - F.col("_base")).alias("d")).where("d is not null")
    whole = d.groupBy("branch").agg(F.count("*").alias("n"), F.avg("d").alias("diff"))
    draw = drawn(F.col("qid"), F.col("round"), seed)
    x = _rounds(d, rounds).select("branch", "round", "d", times(draw).alias("w"), F.when(draw % 2 == 0, F.col("d")).otherwise(-F.col("d")).alias("flip"))
    m = x.groupBy("branch", "round").agg((F.sum(F.col("w") * F.col("d")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"), F.avg("flip").alias("flip"))
    far = F.abs("flip") >= F.abs("diff") - 1e-9
    t = m.join(whole.select("branch", "diff"), "branch").groupBy("branch").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(far.cast("double")).alias("p"))
    return whole.join(t, "branch").select("branch", "n", F.round("diff", 9).alias("diff"), F.round(F.col("q")[0], 9).alias("low"), F.round(F.col("q")[1], 9).alias("high"), F.round("p", 9).alias("p"))


def marginal(docs: DataFrame, qrels: DataFrame, order: list[str], k: int, threshold: int = RELEVANT) -> DataFrame:
    """(step, branch, new, judged, relevant, recall): documents that each branch adds to those before it on judged queries, and the union's recall."""
    at = F.create_map(*(x for i, b in enumerate(order) for x in (F.lit(b), F.lit(i))))
    j = judged(qrels).groupBy("qid", "doc_id").agg(F.max("grade").alias("grade"))
    first = docs.where(F.col("branch").isin(order) & (F.col("rank") <= k)).join(j.select("qid").distinct(), "qid", "left_semi").groupBy("qid", "doc_id").agg(F.min(at[F.col("branch")]).alias("step"))
    x = first.join(j, ["qid", "doc_id"], "left").groupBy("step").agg(F.count("*").alias("new"), F.count("grade").alias("judged"), F.sum(F.when(F.col("grade") >= threshold, 1).otherwise(0)).alias("relevant"))
    total = j.where(F.col("grade") >= threshold).agg(F.count("*").alias("total"))
    steps = docs.sparkSession.createDataFrame([(i, b) for i, b in enumerate(order)], "step int, branch string")
    y = steps.join(x, "step", "left").fillna(0, ["new", "judged", "relevant"]).crossJoin(F.broadcast(total))
    w = Window.orderBy("step")  # one row for each branch
    return y.select(F.col("step").cast("long").alias("step"), "branch", "new", "judged", F.col("relevant").cast("long").alias("relevant"), F.round(F.try_divide(F.sum("relevant").over(w), F.col("total")), 6).alias("recall"))
