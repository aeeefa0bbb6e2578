"""Consensus of several annotators' labels by a mean-field variational confusion model.

Every item has a true class; every annotator has a row of answer probabilities for each true class. Classes and rows have Dirichlet
priors. The updates are group-bys: an item's class probabilities from the expected log-probabilities (digammas) of its labels, an
annotator's row counts from the class probabilities of the items it labelled. Labels are laid out by item once, so that a round is one exchange of
partial counts by annotator; only the annotators' table is written between rounds. Rounds end when its counts no longer change (TOLERANCE);
where ROUNDS don't suffice a warning says so. Reported are the consensus and its probability, each annotator's expected accuracy with a credible
interval (quantiles of the Beta distribution with the posterior's mean and variance), and Krippendorff's alpha.

Defined results: grades out of CLASSES, null grades, null items and null annotators are left out; repeated rows count once; where an
annotator gave an item several grades, the lowest counts; equal probabilities go to the lower grade; empty input gives empty results.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import BROADCAST_ROWS, discard, small_enough, written

CLASSES = (0, 1, 2)
#: Rounds at most, and the change of the annotators' counts, as a share of all labels, at which they end.
ROUNDS, TOLERANCE = 60, 5e-5
#: Mass of a credible interval.
CREDIBLE = 0.95
#: Pseudo-counts of the priors: for a class, for a right and for each wrong answer.
PRIOR_CLASS, PRIOR_RIGHT, PRIOR_WRONG = 1.0, 2.0, 1.0
MIN_LABELERS = 3


def digamma(x: Column) -> Column:
    """Digamma of a positive column: six steps up, then the asymptotic series."""
    y = x + 6
    i = 1 / (y * y)
    series = F.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))
    return series - reduce(Column.__add__, [1 / (x + k) for k in range(6)])


def answers(labels: DataFrame, item: str = "item", labeler: str = "labeler", grade: str = "grade") -> DataFrame:
    ok = F.col(grade).isin(*CLASSES) & F.col(item).isNotNull() & F.col(labeler).isNotNull()
    return labels.where(ok).groupBy(F.col(item).alias("item"), F.col(labeler).alias("labeler")).agg(F.min(grade).cast("int").alias("grade"))


def _digamma(x: float) -> float:
    """The same of a number."""
    i = 1 / (x + 6) ** 2
    return math.log(x + 6) - 0.5 / (x + 6) - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240))) - sum(1 / (x + k) for k in range(6))


_CELLS = [f"b_{k}_{l}" for k in CLASSES for l in CLASSES]


def _posterior(labels: DataFrame, conf: DataFrame, mass: list[float], few: bool) -> DataFrame:
    """(item, q.., n) by the annotators' counts and the classes' mass; few: the annotators' table may be broadcast."""
    rows = {k: reduce(Column.__add__, [F.col(f"b_{k}_{l}") for l in CLASSES]) for k in CLASSES}
    # digammas of all cells and rows by one small expression each; then one row for each annotator and answer: the expected log-probability of that answer under each true class
    n = len(CLASSES)
    x = conf.select("labeler", F.transform(F.array(*_CELLS), digamma).alias("c"), F.transform(F.array(*(rows[k] for k in CLASSES)), digamma).alias("r"))
    answer = lambda l: F.struct(F.lit(CLASSES[l]).alias("grade"), *((F.col("c")[k * n + l] - F.col("r")[k]).alias(f"e{CLASSES[k]}") for k in range(n)))
    logs = x.select("labeler", F.explode(F.array(*map(answer, range(n)))).alias("x")).select("labeler", "x.*")
    scored = labels.join(F.broadcast(logs) if few else logs.hint("merge"), ["labeler", "grade"]).groupBy("item").agg(*(F.sum(f"e{k}").alias(f"e{k}") for k in CLASSES), F.count("*").alias("n"))
    total = [PRIOR_CLASS + m for m in mass]
    scored = scored.select("item", "n", *((F.col(f"e{k}") + (_digamma(total[k]) - _digamma(sum(total)))).alias(f"e{k}") for k in CLASSES))
    top = F.greatest(*(F.col(f"e{k}") for k in CLASSES))
    ex = [F.exp(F.col(f"e{k}") - top) for k in CLASSES]
    return scored.select("item", *((ex[k] / reduce(Column.__add__, ex)).alias(f"q{k}") for k in CLASSES), "n")


def _counts(labels: DataFrame, items: DataFrame) -> DataFrame:
    """Annotators' expected counts with the priors, and m.., what their labels add to the classes' mass, by the items' class probabilities. Both sides are laid out by item."""
    cells = [F.sum(F.when(F.col("grade") == l, F.col(f"q{k}")).otherwise(0.0)).alias(f"b_{k}_{l}") for k in CLASSES for l in CLASSES]
    sums = labels.join(items, "item").groupBy("labeler").agg(*cells, *(F.sum(F.col(f"q{k}") / F.col("n")).alias(f"m{k}") for k in CLASSES))
    prior = lambda c: PRIOR_RIGHT if c[2] == c[4] else PRIOR_WRONG
    return sums.select("labeler", *((F.col(c) + prior(c)).alias(c) for c in _CELLS), *(f"m{k}" for k in CLASSES))


def model(labels: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(items, annotators) of answers().

    items: (item, q0.., n). annotators: (labeler, b_k_l: expected counts of answer l for true class k, with the priors).
    """
    labels = written(labels, "answers").repartition("item").persist(StorageLevel.MEMORY_AND_DISK)  # what is lost with an executor is read again
    start = labels.groupBy("item").agg(*((F.sum((F.col("grade") == k).cast("double")) / F.count("*")).alias(f"q{k}") for k in CLASSES), F.count("*").alias("n"))
    conf = written(_counts(labels, start), "confusion")
    mass_of = lambda c: list(c.agg(*(F.coalesce(F.sum(f"m{k}"), F.lit(0.0)) for k in CLASSES)).first())
    few = small_enough(conf, BROADCAST_ROWS // 8)  # the table has as many rows in every round, and the answers' three times as many
    mass, converged = mass_of(conf), False
    for _ in range(rounds):
        now = written(_counts(labels, _posterior(labels, conf, mass, few)), "confusion")
        old = conf.select("labeler", *(F.col(c).alias(f"old_{c}") for c in _CELLS))
        moved, size, *mass = now.join(F.broadcast(old) if few else old, "labeler").agg(
            F.coalesce(F.sum(reduce(Column.__add__, [F.abs(F.col(c) - F.col(f"old_{c}")) for c in _CELLS])), F.lit(0.0)), F.coalesce(F.sum(reduce(Column.__add__, map(F.col, _CELLS))), F.lit(1.0)), *(F.coalesce(F.sum(f"m{k}"), F.lit(0.0)) for k in CLASSES)
        ).first()
        discard(conf)
        conf, converged = now, moved <= TOLERANCE * size
        if converged:
            break
    if not converged:
        warnings.warn(f"the consensus model hasn't converged in {rounds} rounds", stacklevel=2)
    items = written(_posterior(labels, conf, mass, few), "items")
    labels.unpersist()
    return items, conf.select("labeler", *_CELLS)


def consensus(items: DataFrame) -> DataFrame:
    """(item, consensus, probability, n_labelers)."""
    top = F.greatest(*(F.col(f"q{k}") for k in CLASSES))
    return items.select("item", F.coalesce(*(F.when(F.col(f"q{k}") == top, k) for k in CLASSES)).cast("int").alias("consensus"), F.round(top, 6).alias("probability"), F.col("n").cast("long").alias("n_labelers"))


def reliability(items: DataFrame, annotators: DataFrame) -> DataFrame:
    """(labeler, accuracy, low, high): expected share of right answers and its credible interval of CREDIBLE mass."""
    mass = items.agg(*(F.coalesce(F.sum(f"q{k}"), F.lit(0.0)).alias(f"q{k}") for k in CLASSES)).first()
    total = sum(mass[f"q{k}"] + PRIOR_CLASS for k in CLASSES)
    share = [(mass[f"q{k}"] + PRIOR_CLASS) / total for k in CLASSES]
    rows = {k: reduce(Column.__add__, [F.col(f"b_{k}_{l}") for l in CLASSES]) for k in CLASSES}
    p = {k: F.col(f"b_{k}_{k}") / rows[k] for k in CLASSES}
    mean = reduce(Column.__add__, [share[k] * p[k] for k in CLASSES])
    var = reduce(Column.__add__, [share[k] ** 2 * p[k] * (1 - p[k]) / (rows[k] + 1) for k in CLASSES])
    x = annotators.select("labeler", mean.alias("mean"), var.alias("var"))

    @F.pandas_udf("low double, high double")
    def interval(mean: pd.Series, var: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([beta_interval(m, v) for m, v in zip(mean, var)], columns=["low", "high"])

    x = x.withColumn("i", interval("mean", "var"))
    return x.select("labeler", F.round("mean", 6).alias("accuracy"), F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


def beta_interval(mean: float, var: float, mass: float = CREDIBLE, steps: int = 4000) -> tuple[float, float]:
    """Quantiles that leave equal masses outside of the Beta distribution with a mean and variance, by sums over a grid around the mean."""
    n = mean * (1 - mean) / max(var, 1e-15) - 1
    if n <= 0:
        return 0.0, 1.0
    a, b, width = mean * n, (1 - mean) * n, 10 * var**0.5
    lo, hi = max(0.0, mean - width), min(1.0, mean + width)
    x = lo + (np.arange(steps) + 0.5) * (hi - lo) / steps
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    p = np.cumsum(np.exp(log - log.max()))
    return tuple(float(np.interp(q, p / p[-1], x)) for q in ((1 - mass) / 2, (1 + mass) / 2))


def krippendorff(labels: DataFrame) -> DataFrame:
    """(items, labels, alpha): Krippendorff's alpha of nominal grades over items with two answers at least; null if they can't disagree."""
    cell = labels.groupBy("item", "grade").agg(F.count("*").alias("c"))
    unit = cell.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("m > 1")
    both = cell.join(unit, "item")
    seen = unit.agg(F.count("*").alias("items"), F.sum("m").alias("n"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("do"))
    exp = both.groupBy("grade").agg(F.sum("c").alias("n_c")).agg(F.sum(F.col("n_c") * F.col("n_c")).alias("sq"))
    d = seen.crossJoin(exp)  # one row by one row
    de = (F.col("n") * F.col("n") - F.col("sq")) / (F.col("n") - 1)
    return d.select("items", F.coalesce("n", F.lit(0)).alias("labels"), F.round(1 - F.try_divide(F.col("do"), de), 6).alias("alpha"))


def contradicted(labels: DataFrame, key: DataFrame, qrels: DataFrame, min_labelers: int = MIN_LABELERS) -> DataFrame:
    """(qid, unit_id) of the rows of qrels whose grade isn't the consensus of the item."""
    items, _ = model(answers(labels))
    c = consensus(items).where(F.col("n_labelers") >= min_labelers).join(key.select("item", "qid", "unit_id").distinct(), "item")
    return qrels.select("qid", "unit_id", "grade").join(c, ["qid", "unit_id"]).where(F.col("grade").isNotNull() & (F.col("grade") != F.col("consensus"))).select("qid", "unit_id").distinct()


KRIPPENDORFF_SQL = """
with a as (select item, labeler, min(grade) as grade from labels where grade in (0, 1, 2) and item is not null and labeler is not null group by all),
cell as (select item, grade, count(*) as c from a group by all),
unit as (select item, sum(c) as m, sum(c * (c - 1)) as same from cell group by item having sum(c) > 1),
seen as (select count(*) as items, sum(m) as n, sum((m * (m - 1) - same) / (m - 1)) as d from unit),
e as (select sum(n_c * n_c) as sq from (select grade, sum(c) as n_c from cell join unit using (item) group by grade))
select cast(items as bigint) as items, cast(coalesce(n, 0) as bigint) as labels, round(1 - d / nullif((n * n - sq) / (n - 1), 0), 6) as alpha from seen, e
"""
