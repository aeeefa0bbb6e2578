"""Writers. Jobs commit atomically; _SUCCESS marks a complete output."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_ROWS = 50_000


def corpus(df: DataFrame, path: str, rows: int = PART_ROWS) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def run(df: DataFrame, path: str) -> None:
    df.select(F.col("qid").cast("long"), "unit_id", F.col("doc_id").cast("long"), F.col("rank").cast("int"), F.col("score").cast("float")).write.mode("overwrite").parquet(path)


def postings(df: DataFrame, path: str) -> None:
    """Sparse weights clustered by language and term, so that a search prunes files."""
    df.repartition("lang", "term").sortWithinPartitions("lang", "term").write.mode("overwrite").partitionBy("lang").parquet(path)


def sheets(df: DataFrame, path: str) -> None:
    df.repartition("labeler").sortWithinPartitions("labeler", "qid", "item").write.mode("overwrite").partitionBy("labeler").option("header", True).csv(path)


def table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def submission(rows: DataFrame, path: str, name: str = "submission.json", most_bytes: int = 99_000_000) -> int:
    """One zip with a JSON array of rows (qid, rank and others); the ranks are cut by a twentieth until it fits. Returns the depth used.

    A submission is small by definition (most_bytes); rows go through the driver one by one.
    """
    depth = rows.agg(F.max("rank")).first()[0] or 0
    while True:
        cut = rows.where(F.col("rank") <= depth).orderBy("qid", "rank")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w") as f:
            f.write(b"[")
            for i, r in enumerate(cut.toLocalIterator()):
                f.write((b",\n" if i else b"\n") + json.dumps(r.asDict(), ensure_ascii=False).encode())
            f.write(b"\n]\n")
        if Path(path).stat().st_size <= most_bytes or depth <= 10:
            return depth
        depth = int(depth * 0.95)
