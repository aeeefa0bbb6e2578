"""Top N items within every group by statistics-guided skipping.

The table is laid out once: range-partitioned and sorted by (group, score descending), so that a file's row groups hold
few groups each and a hot group spreads over many row groups and files. A query reads the footers, then the row groups
in descending maximum score, and leaves out those that lie strictly below the current N-th score of every group they hold.

Defined results: null and NaN scores are no scores, so a group without scores is absent; a null group column is a group
of its own; rows with a null item are left out; an item that occurs several times counts once, with its highest score;
equal scores are ordered by item ascending (by code point); an empty table gives an empty result. Columns of the input
other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import bounded_join, discard, work_path, written

#: Bytes of a row group in the layout, which is what one read or one skip is worth: grows with the table between these bounds, to about BLOCKS row groups.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 20, 128 << 20, 4096

#: Files that a task keeps open.
OPEN_FILES = 32

_KEYS = ["_g1", "_g2"]


def cluster(df: DataFrame, group: list[str], item: str, score: str, block_bytes: int | None = None) -> str:
    """Write the layout to the shared folder and return its path. It serves any number of calls of top_n."""
    cols = [F.col(c).alias(f"g_{i}") for i, c in enumerate(group)] + [F.col(item).alias("_item"), F.col(score).alias("_score")]
    kind = dict(df.dtypes)[score]
    has = F.col(score).isNotNull() & F.col(item).isNotNull()
    if kind in ("float", "double"):
        has = has & ~F.isnan(score)
    g = [f"g_{i}" for i in range(len(group))]
    rows = df.where(has).select(*cols).select("*", F.xxhash64(*g).alias("_g1"), F.xxhash64(F.lit(17), *reversed(g)).alias("_g2"))
    order = [F.col("_g1"), F.col("_g2"), F.col("_score").desc(), F.col("_item")]
    if block_bytes is None:
        block_bytes = min(MOST_BLOCK, max(LEAST_BLOCK, rows.count() * 48 // BLOCKS))
    path = work_path(df.sparkSession, "clustered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.size", block_bytes).parquet(path)
    return path


def _open(uri: str) -> pq.ParquetFile:
    fs, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pq.ParquetFile(fs.open_input_file(path))


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for uri in b["file"]:
            meta = _open(uri).metadata
            at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            out = []
            for k in range(meta.num_row_groups):
                rg = meta.row_group(k)
                s = {c: rg.column(at[c]).statistics for c in (*_KEYS, "_score")}
                known = all(x is not None and x.has_min_max for x in s.values())
                single = known and all(s[c].min == s[c].max for c in _KEYS)
                out.append((uri, k, rg.num_rows, float(s["_score"].max) if known else float("inf"), single, s["_g1"].min if single else 0, s["_g2"].min if single else 0))
            yield pd.DataFrame(out, columns=["file", "rg", "n", "top", "single", "_g1", "_g2"]).astype({"single": bool, "_g1": "int64", "_g2": "int64"})


def _reader(n: int, columns: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first n distinct items of every group of each row group. Row groups come in descending maximum score."""
        best: dict[tuple[int, int], list[float]] = {}
        files: dict[str, pq.ParquetFile] = {}  # of which the last few stay open, so that footers aren't read for each row group
        for b in batches:
            for uri, rg, top, single, g1, g2 in zip(*(b.column(c).to_pylist() for c in ("file", "rg", "top", "single", "_g1", "_g2"))):
                now = best.get((g1, g2)) if single else None
                if now is not None and len(now) == n and top < now[-1]:
                    continue
                if uri not in files:
                    if len(files) >= OPEN_FILES:
                        files.pop(next(iter(files)))
                    files[uri] = _open(uri)
                t = files[uri].read_row_group(rg, columns)
                a, c = (t.column(k).to_numpy() for k in _KEYS)
                new = np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])) if len(a) else np.zeros(0, bool)
                gid = np.cumsum(new)
                item = t.column("_item").combine_chunks().dictionary_encode()
                code = (item.indices if isinstance(item, pa.DictionaryArray) else item.combine_chunks().indices).to_numpy().astype(np.int64)
                key = gid * (int(code.max()) + 1 if len(code) else 1) + code
                first = np.sort(np.unique(key, return_index=True)[1])  # rows are sorted, so an item's first row has its highest score
                start = np.searchsorted(gid[first], gid[first])
                keep = first[np.arange(len(first)) - start < n]
                t = t.take(pa.array(keep))
                if single and t.num_rows == n and (g1, g2) not in best:
                    best[g1, g2] = sorted(t.column("_score").to_pylist(), reverse=True)
                yield from t.to_batches()

    return read


def top_n(spark: SparkSession, path: str, group: list[str], item: str, score: str, n: int) -> DataFrame:
    """The n best items of every group of a layout that cluster() wrote, with their place (1 is the best)."""
    table = spark.read.parquet(path)
    files = table.inputFiles()
    out = [F.col(f"g_{i}").alias(c) for i, c in enumerate(group)] + [F.col("_item").alias(item), F.col("_score").alias(score), "place"]
    g = [f"g_{i}" for i in range(len(group))]
    w = Window.partitionBy(*g).orderBy(F.col("_score").desc(), "_item")
    best = lambda df: df.groupBy(*_KEYS, *g, "_item").agg(F.max("_score").alias("_score")).select("*", F.row_number().over(w).alias("place")).where(F.col("place") <= n)
    if not files:
        return best(table).select(*out)
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    blocks = written(
        spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks).mapInPandas(_footers, "file string, rg int, n long, top double, single boolean, _g1 long, _g2 long"), "footers"
    )
    lead = Window.partitionBy("single", *_KEYS, F.when(F.col("single"), F.lit("")).otherwise(F.concat_ws(":", "file", "rg"))).orderBy(F.desc("top"), F.desc("n"), "file", "rg")
    footers, blocks = blocks, written(blocks.withColumn("turn", F.row_number().over(lead)), "blocks")
    discard(footers)
    read = lambda b: b.repartition(tasks, "file", "rg").sortWithinPartitions(F.desc("top"), "file", "rg").mapInArrow(_reader(n, table.columns), table.schema)
    first = written(read(blocks.where("turn = 1")), "first")
    # the N-th score so far; a row group strictly below it can't change the result
    bar = written(best(first).where(F.col("place") == n).select(*_KEYS, F.col("_score").cast("double").alias("bar")), "bar")
    rest = bounded_join(blocks.where("turn > 1"), bar, _KEYS, "left").where("bar is null or top >= bar").drop("bar")
    return best(first.unionByName(read(rest))).select(*out)
