"""Ranks within groups that hold up when one group holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_join, written

#: A group with more distinct values than this is cut into ranges of values, each ranked on its own.
HOT_VALUES = 500_000


def _bucketed(df: DataFrame, group: list[str], value: str, hot_values: int) -> tuple[DataFrame, bool]:
    """df with _bucket, ascending with the value, and whether any group has more than one: those of more than hot_values rows.

    The bounds are approximate quantiles, taken once and written, so that every reader of the result sees the same ones.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_values)
    hot = written(sizes, "hot")
    if hot.isEmpty():
        return df.withColumn("_bucket", F.lit(0)), False
    parts = 64
    bounds = bounded_join(df, hot, group).groupBy(*group).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("_bounds"))
    out = bounded_join(df, written(bounds, "bounds"), group, "left")
    return out.withColumn("_bucket", F.when(F.col("_bounds").isNull(), 0).otherwise(F.size(F.filter("_bounds", lambda b: b < F.col(value))))).drop("_bounds"), True


def _offsets(counts: DataFrame, group: list[str], what: str) -> DataFrame:
    """For each (group, bucket) the sum of what over the higher buckets. At most 64 rows a group."""
    w = Window.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    return counts.groupBy(*group, "_bucket").agg(F.sum(what).alias("_s")).select(*group, "_bucket", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))


def tie_ranks(df: DataFrame, group: list[str], value: str, hot_values: int = HOT_VALUES) -> DataFrame:
    """(group, value, n, rank2): ranks of the distinct values, best (largest) first, with averaged ties.

    rank2 is twice the rank, so that it is whole: values that stand in n rows from place p on have rank p + (n - 1) / 2.
    Nulls in value are left out; null groups are groups. Equal values are counted before anything is sorted.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    c, split = _bucketed(counts, group, value, hot_values)
    w = Window.partitionBy(*group, "_bucket").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    inner = c.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    if not split:
        return inner.select(*group, value, "n", (2 * F.col("_in") + F.col("n") + 1).alias("rank2"))
    out = _null_safe(inner, _offsets(c, group, "n"), [*group, "_bucket"])
    return out.select(*group, value, "n", (2 * (F.col("_in") + F.col("_before")) + F.col("n") + 1).alias("rank2"))


def _null_safe(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    for c in on:
        b = b.withColumnRenamed(c, f"_r_{c}")
    cond = [a[c].eqNullSafe(b[f"_r_{c}"]) for c in on]
    joined = a.join(b, cond, "left")
    return joined.drop(*(f"_r_{c}" for c in on))


def places(df: DataFrame, group: list[str], value: str, ties: list[Column | str], hot_values: int = HOT_VALUES) -> DataFrame:
    """df with place: 1, 2, ... within the group, the largest value first, ties in the order of ties."""
    c, split = _bucketed(df, group, value, hot_values)
    w = Window.partitionBy(*group, "_bucket").orderBy(F.desc(value), *ties)
    inner = c.withColumn("_in", F.row_number().over(w).cast("long"))
    if not split:
        return inner.withColumnRenamed("_in", "place").drop("_bucket")
    ones = c.withColumn("_one", F.lit(1))
    return _null_safe(inner, _offsets(ones, group, "_one"), [*group, "_bucket"]).withColumn("place", F.col("_in") + F.col("_before")).drop("_in", "_before", "_bucket")
