"""One ranking from several differently-scaled scores: a Borda count.

Within every list (branch) of a group the scores become competition ranks with averaged ties, so that no list weighs more because
its numbers are larger. Items that a list of the group doesn't score share its last places and get the middle of them. An item's points
in a list are the number of the group's items less its rank; points are weighted, summed and sorted, ties by item.

Defined results: null and NaN scores are no scores; an item scored twice in a list counts once, with its higher score; a list without
any score in a group says nothing there; items of which no list has a score still get a place; null groups and null items are
left out; a constant list gives all its items the same points. Points are kept doubled, so that they are whole for whole weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import places, tie_ranks
from ..session import bounded_join, written

#: Groups of more rows than this are ranked in pieces; smaller ones in one pass over rows partitioned by group.
HOT_ROWS = 200_000


def _points(items: DataFrame, n: Column, lists: Column, listed: Column) -> DataFrame:
    """Doubled points of items (g, i, lists, w, gain, fw, fm).

    In a list of m scores an item of rank r gets n - r points, and one that it leaves out the middle of the places m + 1 to n. Summed over
    lists this is w * n + gain + (n * sum of weights - sum of weighted m + 1), so that no row is made for an absent score.
    """
    return items.select("g", "i", (F.col("w") * n + F.col("gain") + n * lists - listed).cast("long").alias("points2"), "lists")


def _weight(weights: dict[str, int] | None) -> Column:
    w = F.lit(1)
    for k, v in (weights or {}).items():
        w = F.when(F.col("b") == k, v).otherwise(w)
    return w


def _items(entries: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """Per item from entries (g, b, i, s, rank2, m, first): lists that score it, their weight, its gain, and what its
    list's first entry carries for the whole list."""
    w, has = _weight(weights), F.col("s").isNotNull()
    sums = {"lists": F.lit(1), "w": w, "gain": w * (F.col("m") + 1 - F.col("rank2")), "fw": F.when(F.col("first"), w).otherwise(0), "fm": F.when(F.col("first"), w * (F.col("m") + 1)).otherwise(0)}
    return entries.groupBy("g", "i").agg(*(F.sum(F.when(has, v).otherwise(0)).alias(k) for k, v in sums.items()))


def borda(df: DataFrame, group: str = "qid", branch: str = "branch", item: str = "unit_id", score: str = "score", weights: dict[str, int] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, item, points2, lists, place): one order of every group's items."""
    valid = F.col(score).isNotNull()
    if dict(df.dtypes)[score] in ("float", "double"):
        valid = valid & ~F.isnan(score)
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(branch).alias("b"), F.col(item).alias("i"), F.when(valid, F.col(score)).alias("s"))
    # groups over hot_rows: fewer than rows / hot_rows
    hot = written(rows.groupBy("g").count().where(F.col("count") > hot_rows).select("g"), "hot")
    some = not hot.isEmpty()
    out = _cold(bounded_join(rows, hot, ["g"], "left_anti") if some else rows, weights)
    if some:
        out = out.unionByName(_hot(bounded_join(rows, hot, ["g"], "left_semi"), weights))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "points2", F.col("lists").cast("long").alias("lists"), F.col("place").cast("long").alias("place"))


def _cold(rows: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """All steps after one exchange by group."""
    best = rows.repartition("g").groupBy("g", "b", "i").agg(F.max("s").alias("s"))
    w = Window.partitionBy("g", "b").orderBy(F.desc_nulls_last("s"))
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    m = F.count("s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    entries = best.select("*", (2 * F.rank().over(w) + ties - 1).alias("rank2"), m.alias("m"), (F.row_number().over(w) == 1).alias("first"))
    g = Window.partitionBy("g")
    points = _points(_items(entries, weights), F.count("*").over(g), F.sum("fw").over(g), F.sum("fm").over(g))
    return points.select("*", F.row_number().over(g.orderBy(F.desc("points2"), "i")).alias("place"))


def _hot(rows: DataFrame, weights: dict[str, int] | None) -> DataFrame:
    """The same for groups that no single task should hold."""
    best = written(rows.groupBy("g", "b", "i").agg(F.max("s").alias("s")), "best")
    ranks = tie_ranks(best, ["g", "b"], "s").withColumnsRenamed({"g": "rg", "b": "rb", "s": "rs"}).drop("n")
    size = best.groupBy("g", "b").agg(F.count("s").alias("m"), F.min(F.when(F.col("s").isNotNull(), F.col("i"))).alias("one")).withColumnsRenamed({"g": "lg", "b": "lb"})
    e = best.join(ranks, (F.col("g") == F.col("rg")) & F.col("b").eqNullSafe(F.col("rb")) & (F.col("s") == F.col("rs")), "left")
    e = e.join(size, (F.col("g") == F.col("lg")) & F.col("b").eqNullSafe(F.col("lb"))).withColumn("first", F.col("i") == F.col("one"))
    items = written(_items(e, weights), "items")
    total = items.groupBy("g").agg(F.count("*").alias("n"), F.sum("fw").alias("tw"), F.sum("fm").alias("tm"))
    return places(_points(items.join(total, "g"), F.col("n"), F.col("tw"), F.col("tm")), ["g"], "points2", ["i"])


SQL = """
with best as (select qid as g, branch as b, unit_id as i, max(case when isnan(score) then null else score end) as s from runs
  where qid is not null and unit_id is not null group by all),
n as (select g, count(distinct i) as n from best group by g),
scored as (select *, rank() over (partition by g, b order by s desc) as lo, count(*) over (partition by g, b, s) as ties from best where s is not null),
lists as (select g, b, n, n - count(*) - 1 as absent from scored join n using (g) group by g, b, n),
base as (select g, sum(absent) as base from lists group by g),
gained as (select s.g, s.i, sum(2 * l.n - (2 * lo + ties - 1) - absent) as gain, count(*) as lists
  from scored s join lists l on s.g = l.g and s.b is not distinct from l.b group by s.g, s.i),
items as (select distinct g, i from best),
points as (select g, i, coalesce(gain, 0) + coalesce(base, 0) as points2, coalesce(lists, 0) as lists from items left join gained using (g, i) left join base using (g))
select g as qid, i as unit_id, cast(points2 as bigint) as points2, cast(lists as bigint) as lists, row_number() over (partition by g order by points2 desc, i) as place from points
"""
