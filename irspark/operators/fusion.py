"""Reciprocal rank fusion of any number of configurations in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runs import to_parents

RRF_K = 60


def parse_item(spec: str) -> tuple[str, float]:
    """'name*weight' or 'name'."""
    name, _, w = spec.partition("*")
    return name.strip(), float(w) if w.strip() else 1.0


def config(spark: SparkSession, configs: dict[str, list[str]]) -> DataFrame:
    """(config, branch, weight); a few rows, broadcast by its known size."""
    rows = [(c, *parse_item(s)) for c, specs in configs.items() for s in specs]
    return F.broadcast(spark.createDataFrame(rows, "config string, branch string, weight double"))


def complete(runs: DataFrame, configs: dict[str, list[str]], strict: bool = False) -> dict[str, list[str]]:
    """Configurations all of whose branches exist; strict raises for the others. Branches are few: their names are collected."""
    have = {r["branch"] for r in runs.select("branch").distinct().collect()}
    out = {c: s for c, s in configs.items() if all(parse_item(x)[0] in have for x in s)}
    if strict and len(out) < len(configs):
        raise ValueError(f"branches missing for {sorted(set(configs) - set(out))}")
    return out


def rrf(runs: DataFrame, cfg: DataFrame, depth: int, k: int | DataFrame = RRF_K, cut: int | None = None) -> DataFrame:
    """(config[, k], qid, unit_id, doc_id, rank, score): the sum of weight / (k + rank) over the lists cut at depth.

    Ties go to the best rank, then unit_id. The sum is rounded to 12 digits, so that its order doesn't hang on the order of adding.
    k may be a frame with a column k: all values are then fused at once.
    """
    rows = runs.where(F.col("rank") <= depth).join(cfg, "branch")
    keys = ["config"]
    if isinstance(k, DataFrame):
        rows, keys = rows.crossJoin(F.broadcast(k)), ["config", "k"]
        term = F.col("weight") / (F.col("k") + F.col("rank"))
    else:
        term = F.col("weight") / (k + F.col("rank"))
    s = rows.groupBy(*keys, "qid", "unit_id", "doc_id").agg(F.round(F.sum(term), 12).alias("score"), F.min("rank").alias("best"))
    w = Window.partitionBy(*keys, "qid").orderBy(F.desc("score"), "best", "unit_id")
    out = s.select(*keys, "qid", "unit_id", "doc_id", F.row_number().over(w).cast("long").alias("rank"), "score")
    return out if cut is None else out.where(F.col("rank") <= cut)


def levels(parents: DataFrame, children: DataFrame, depth: int, child_factor: int = 3, k: int = RRF_K) -> DataFrame:
    """One list per branch and query from its search over parents and its search over children: children are taken child_factor times
    as deep, become their parents, are cut at depth, and both lists are fused with equal weight."""
    c = to_parents(children.where(F.col("rank") <= child_factor * depth)).where(F.col("rank") <= depth)
    both = parents.where(F.col("rank") <= depth).select(c.columns).unionByName(c)
    s = both.groupBy("branch", "qid", "unit_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("score"), F.min("rank").alias("best"))
    w = Window.partitionBy("branch", "qid").orderBy(F.desc("score"), "best", "unit_id")
    return s.select("branch", "qid", "unit_id", "doc_id", F.row_number().over(w).cast("long").alias("rank"), "score").where(F.col("rank") <= depth)
