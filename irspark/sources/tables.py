"""Readers: links, part files, runs, identifier lists, label sheets, records, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def links(spark: SparkSession, path: str) -> DataFrame:
    """(id, url) from Parquet or JSON lines; lines that aren't records are left out."""
    if path.endswith((".jsonl", ".json")):
        return spark.read.schema(schemas.LINKS).json(path).where("id is not null")
    return spark.read.parquet(path).select(F.col("id").cast("long").alias("id"), "url")


def parts(spark: SparkSession, folders: list[str], sub: str, schema: str) -> DataFrame:
    """Rows of all Parquet parts below folders in a directory named sub. A file name that occurs in several folders is read once
    (the first in order); columns that old files lack are null, damaged files are skipped."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", "true").parquet(*folders)
    df = df.withColumn("_path", F.col("_metadata.file_path")).withColumn("_name", F.col("_metadata.file_name")).where(F.col("_path").contains(f"/{sub}/"))
    first = df.groupBy("_name").agg(F.min("_path").alias("_path"))
    return df.join(first, ["_name", "_path"], "left_semi").drop("_path", "_name")


def ids(spark: SparkSession, spec: str) -> DataFrame | None:
    """(qid) from '1,2,3', a text file, a CSV file (column qid or id) or Parquet; None for no restriction."""
    if not spec.strip():
        return None
    if spec.endswith(".parquet"):
        df = spark.read.parquet(spec)
    elif spec.endswith(".csv"):
        df = spark.read.option("header", True).csv(spec)
    elif spec.endswith(".txt"):
        df = spark.read.text(spec).select(F.explode(F.split("value", r"[\s,]+")).alias("qid")).where("qid <> ''")
    else:
        return spark.createDataFrame([(int(x),) for x in spec.split(",") if x.strip()], "qid long").distinct()
    name = "qid" if "qid" in df.columns else "id"
    return df.select(F.col(name).cast("long").alias("qid")).distinct()


def label_sheets(spark: SparkSession, glob: str) -> DataFrame:
    """(item, labeler, tag, grade, note) of sheets named sheet_<tag>_<labeler>.csv; blank and invalid grades are left out, and of an
    item's sheets by one labeler the last file counts."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(glob).withColumn("_file", F.col("_metadata.file_name"))
    grade = F.try_to_number(F.trim("grade"), F.lit("9")).cast("int")
    x = raw.select("item", F.coalesce(F.nullif(F.regexp_extract("_file", r"sheet_([a-z]+\d*)_([A-Za-z0-9]+)", 2), F.lit("")), "_file").alias("labeler"), F.coalesce(F.nullif(F.regexp_extract("_file", r"sheet_([a-z]+\d*)_", 1), F.lit("")), F.lit("?")).alias("tag"), grade.alias("grade"), F.coalesce("note", F.lit("")).alias("note"), "_file")
    x = x.where(F.col("grade").isin(0, 1, 2))
    return x.groupBy("item", "labeler").agg(F.max_by(F.struct("tag", "grade", "note"), "_file").alias("r")).select("item", "labeler", "r.*")


def query_texts(queries: DataFrame) -> DataFrame:
    """(qid, lang, query): trimmed, one text a query and language (the first by code point), without nulls."""
    q = queries.where("id is not null and query is not null and lang is not null and trim(query) <> ''")
    return q.groupBy(F.col("id").alias("qid"), F.trim("lang").alias("lang")).agg(F.min(F.trim("query")).alias("query"))


def with_fallback(queries: DataFrame, lang: str, base: str = "vi") -> DataFrame:
    """(qid, query, used): the text in lang, else in the base language."""
    a = queries.where(F.col("lang") == lang).select("qid", F.col("query").alias("a"))
    b = queries.where(F.col("lang") == base).select("qid", F.col("query").alias("b"))
    return a.join(b, "qid", "full").select("qid", F.coalesce("a", "b").alias("query"), F.when(F.col("a").isNotNull(), lang).otherwise(base).alias("used"))


def spread(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows of every group at even distances in its order, all of a group that has no more."""
    w = Window.partitionBy(group)
    x = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    # row i is taken if some j has floor((j + 1/2) * size / n) = i; the only candidate is the least j with (2j + 1) * size >= 2n * i
    j = F.greatest(F.lit(0), F.ceil((F.lit(2 * n) * F.col("_i") / F.col("_n") - 1) / 2))
    hit = (j < n) & (F.floor((2 * j + 1) * F.col("_n") / (2 * n)) == F.col("_i"))
    return x.where((F.col("_n") <= n) | hit).drop("_i", "_n")
