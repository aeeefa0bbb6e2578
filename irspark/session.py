"""Session helpers: the shared work folder, written intermediate tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes a side may have at most to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need neither an installation nor the driver's folder."""
    sc = spark.sparkContext
    if getattr(sc, "_irspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="irspark-code-")) / "irspark.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("irspark") / f.relative_to(root))
    sc.addPyFile(str(path))
    sc._irspark_shipped = True


def work_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where that is unset, one of its own in local mode, as in tests, and an error on a cluster."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("irspark.workDir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="irspark-")
        spark.conf.set("irspark.workDir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    return f"{work_root(spark).rstrip('/')}/irspark/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cut the lineage: write df to the shared folder as Parquet and read it back.

    The copy survives the loss of executors. The schema is kept, so an empty frame reads back as well.
    """
    path = work_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._irspark_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_irspark_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of what is run within as soon as it has ended, and not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def count_up_to(df: DataFrame, bound: int) -> int:
    """Rows of df, counted to bound + 1 at most."""
    return df.limit(bound + 1).count()


def _width(df: DataFrame) -> Column:
    """About as many bytes as a row takes in memory."""
    fixed, wide = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            wide.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
        elif kind in ("array", "map"):
            each = {"long": 8, "double": 8, "integer": 4, "float": 4}.get(getattr(getattr(f.dataType, "elementType", None), "typeName", str)(), 32)
            wide.append(F.greatest(F.size(f.name), F.lit(0)) * each)
        else:
            fixed += 8
    return reduce(Column.__add__, wide, F.lit(fixed))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, bytes_: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes; it is read no further than to rows + 1."""
    n, size = df.limit(rows + 1).select(_width(df).alias("_w")).agg(F.count("*"), F.coalesce(F.sum("_w"), F.lit(0))).first()
    return n <= rows and size <= bytes_


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts small only if it was measured and has at most bound rows and BROADCAST_BYTES bytes; otherwise both sides
    are shuffled, where adaptive execution splits skewed partitions. Pass a written table as small: it is read twice.
    """
    if small_enough(small, bound):
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)
