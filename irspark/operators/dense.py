"""Dense retrieval: exact inner product, and inverted lists over k-means centroids beyond a size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Queries scored at once against a batch of vectors.
QUERY_BLOCK = 4096


def _top(x: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "unit_id")
    return x.select("qid", "unit_id", F.row_number().over(w).cast("long").alias("rank"), "score").where(F.col("rank") <= k)


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, unit_id, rank, score): the k vectors with the largest inner product. vectors (unit_id, v); queries (qid, v), the stated
    query set, which meets all vectors in blocks: every batch of vectors is multiplied with a block of queries and leaves
    its k best for each query, so what is shuffled is k rows a query and batch.
    """
    out = None
    for ids, q in _blocks(queries):

        def score(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                s = np.stack(b["v"].to_numpy()).astype(np.float64) @ q.T
                n = min(k, len(b))
                u = b["unit_id"].to_numpy()
                top = np.argpartition(-s, n - 1, axis=0)[:n]
                # all that equal the n-th stay in, so that ties are settled by unit_id
                bar = np.take_along_axis(s, top, 0).min(axis=0)
                i, j = np.nonzero(s >= bar[None, :])
                yield pd.DataFrame({"qid": ids[j], "unit_id": u[i], "score": np.round(s[i, j], 6)})

        kind = dict(vectors.dtypes)["unit_id"]
        part = vectors.select("unit_id", "v").where("v is not null").mapInPandas(score, f"qid long, unit_id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.select(F.lit(0).cast("long").alias("qid"), "unit_id", F.lit(0).cast("long").alias("rank"), F.lit(0.0).alias("score")).limit(0)
    return _top(out, k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in queries.where("v is not null").select("qid", "v").toLocalIterator():
        ids.append(r["qid"])
        rows.append(r["v"])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def fit_centroids(vectors: DataFrame, lists: int, sample: int = 50_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors by k-means on a bounded sample of sample rows at most."""
    n = vectors.count()
    x = vectors if n <= sample else vectors.where(F.pmod(F.xxhash64("unit_id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    m = np.array([r["v"] for r in x.orderBy("unit_id").select("v").collect()], np.float64)
    lists = max(1, min(lists, len(m) // 39 or 1))
    if not len(m):
        return np.zeros((0, 0))
    c = m[np.random.default_rng(seed).permutation(len(m))[:lists]]
    for _ in range(rounds):
        a = (m @ c.T).argmax(axis=1)
        c = np.stack([m[a == i].mean(axis=0) if (a == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def assign(df: DataFrame, centroids: np.ndarray, id: str, n: int = 1) -> DataFrame:
    """df (id, v) with list: the n nearest centroids, a row each."""
    kind = dict(df.dtypes)[id]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = np.stack(b["v"].to_numpy()).astype(np.float64) @ centroids.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({id: np.repeat(b[id].to_numpy(), top.shape[1]), "v": np.repeat(b["v"].to_numpy(), top.shape[1]), "list": top.ravel()})

    return df.where("v is not null").select(id, "v").mapInPandas(near, f"{id} {kind}, v array<float>, list int")


def ivf(vectors: DataFrame, queries: DataFrame, k: int, lists: int = 16, probe: int = 6) -> DataFrame:
    """Approximate search: an equality join on the probe nearest lists of each query, exact scores within them."""
    c = fit_centroids(vectors, lists)
    index = written(assign(vectors, c, "unit_id"), "ivf")
    q = assign(queries, c, "qid", probe).withColumnRenamed("v", "w")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    x = index.join(q, "list").select("qid", "unit_id", F.round(dot, 6).alias("score"))
    return _top(x, k)


def maxsim(pairs: DataFrame) -> DataFrame:
    """(qid, unit_id, score): mean over the query's vectors of the best inner product with the unit's; pairs (qid, unit_id, qs, us) holds
    arrays of vectors. 0 if either is empty."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = F.transform("qs", lambda q: F.array_max(F.transform("us", lambda u: dot(q, u))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("qs")
    return pairs.select("qid", "unit_id", F.round(F.when((F.size("qs") > 0) & (F.size("us") > 0), mean).otherwise(0.0), 6).alias("score"))
