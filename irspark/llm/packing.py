"""Filling containers of fixed capacity with texts: a linear grouping scheme.

Sizes are tokens of a public tokenizer (a file given by path). Items over LARGE of the capacity are sorted by size and cut
into GROUPS groups of equal count, each rounded up to its largest; configurations of these few sizes are optimised on the histogram,
which has as many rows as the capacity at most; actual items take the configurations' places; then small items are placed by best fit
into the room that is really left, in shards of bounded size, and open containers of their own where none has room.

Defined results: null ids are left out; null and empty texts have no tokens and no container; a text over the capacity fills
containers of its own and its rest is packed as an item (part counts its pieces); repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_join, written

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Items over this share of the capacity are grouped; at most three of them fit one container.
LARGE = 0.25
GROUPS = 96
#: Items of a shard, for numbering and for best fit.
SHARD_ITEMS = 40_000

# Fixed value: how the byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(df: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row with an id."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(count, "doc_id long, n_tokens long")


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(items of each group, containers)]: repeatedly the fullest container that holds the largest size left, as often as it can be filled."""
    left = list(counts)
    out = []
    for g in range(len(sizes)):
        while left[g] > 0:
            best, fill = (g,), sizes[g]
            for a in range(g, len(sizes)):
                if not left[a] or (a == g and left[g] < 2) or sizes[g] + sizes[a] > capacity:
                    continue
                two = sizes[g] + sizes[a]
                if two > fill:
                    best, fill = (g, a), two
                for b in range(a, len(sizes)):
                    need = {k: (g, a, b).count(k) for k in (g, a, b)}
                    if two + sizes[b] <= capacity and two + sizes[b] > fill and all(left[k] >= n for k, n in need.items()):
                        best, fill = (g, a, b), two + sizes[b]
                        break  # sizes fall, so the first that fits is the largest
            need = {k: best.count(k) for k in best}
            times = min(left[k] // n for k, n in need.items())
            for k, n in need.items():
                left[k] -= n * times
            out.append((need, times))
    return out


def _best_fit(capacity: int, shards: int, first: int):
    def fit(key, rooms: pd.DataFrame, small: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        open_: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0
        for c, r in sorted(zip(rooms["container"].tolist(), rooms["room"].tolist()), reverse=True):
            open_[r].append(c)
            mask |= 1 << r
        small = small.sort_values(["n_tokens", "doc_id", "part"], ascending=[False, True, True])
        out, opened = [], 0
        for n in small["n_tokens"].tolist():
            m = mask >> n
            if m:
                r = n + (m & -m).bit_length() - 1
                c = open_[r].pop()
                if not open_[r]:
                    mask &= ~(1 << r)
            else:
                r, c = capacity, first + opened * shards + shard
                opened += 1
            out.append(c)
            r -= n
            if r:
                open_[r].append(c)
                mask |= 1 << r
        return pd.DataFrame({"doc_id": small["doc_id"], "part": small["part"], "n_tokens": small["n_tokens"], "container": np.array(out, np.int64)})

    return fit


def pack(counts: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, part, n_tokens, container) for (doc_id, n_tokens)."""
    # a number of its own for every row, fixed by writing it: repeated rows spread over shards like any others
    counts = written(counts.where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()), "counts")
    spark = counts.sparkSession
    whole, rest = F.floor(F.col("n_tokens") / capacity), F.col("n_tokens") % capacity
    pieces = counts.select("doc_id", "row", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / capacity) - 1), lambda p: F.struct(p.alias("part"), F.when(p < whole, capacity).otherwise(rest).alias("n_tokens")))).alias("x")).select("doc_id", "row", F.col("x.part").cast("int").alias("part"), F.col("x.n_tokens").cast("int").alias("n_tokens"))
    n = counts.agg(F.coalesce(F.sum(F.ceil(F.col("n_tokens") / capacity)), F.lit(0))).first()[0]  # pieces, of which one text may have most
    shards = max(1, -(-n // shard_items))
    items = pieces.withColumn("shard", F.pmod(F.xxhash64("row", "part"), F.lit(shards)).cast("int"))
    # numbers within (size, shard), then offsets of the larger sizes and earlier shards: no sort of all items in one task
    hist = items.groupBy("n_tokens", "shard").agg(F.count("*").alias("c"))
    by_size = {r["n_tokens"]: r["c"] for r in hist.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # capacity rows at most
    full = by_size.get(capacity, 0)
    large = sorted((s for s in by_size if LARGE * capacity < s < capacity), reverse=True)
    total = sum(by_size[s] for s in large)
    w = Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start, before = {}, 0
    for s in [capacity, *large]:
        start[s] = 0 if s == capacity else before
        before += by_size[s] if s != capacity else 0
    starts = spark.createDataFrame([(int(s), int(v)) for s, v in start.items()], "n_tokens int, _start long")
    offsets = written(hist.where(F.col("n_tokens") > LARGE * capacity).withColumn("_off", F.coalesce(F.sum("c").over(w), F.lit(0))).join(F.broadcast(starts), "n_tokens").select("n_tokens", "shard", (F.col("_off") + F.col("_start")).alias("_first")), "offsets")
    number = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "part", "row")
    placed = bounded_join(items.where(F.col("n_tokens") > LARGE * capacity).withColumn("_no", F.row_number().over(number) - 1), offsets, ["n_tokens", "shard"]).withColumn("pos", F.col("_first") + F.col("_no"))
    filled = placed.where(F.col("n_tokens") == capacity).select("doc_id", "part", "n_tokens", F.col("pos").alias("container"))
    # groups of equal count by place; each is rounded up to its first, which is its largest
    per = max(1, -(-total // groups))
    cuts = list(range(0, total, per))
    sizes, sums, k = [], 0, 0
    ends = []
    for s in large:
        ends.append((sums + by_size[s], s))
        sums += by_size[s]
    for c in cuts:
        while ends[k][0] <= c:
            k += 1
        sizes.append(ends[k][1])
    used = [0] * len(cuts)
    lookup, base = [], full
    for need, times in configurations(sizes, [min(per, total - c) for c in cuts], capacity):
        for g, a in need.items():
            lookup.append((g, used[g], used[g] + a * times, base, a))
            used[g] += a * times
        base += times
    table = spark.createDataFrame(lookup, "g int, lo long, hi long, base long, a long")
    inside = (F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi"))
    chosen = placed.where(F.col("n_tokens") < capacity).withColumn("g", F.floor(F.col("pos") / per).cast("int")).withColumn("idx", F.col("pos") % per)
    # a few configurations for each group: bounded by GROUPS squared, whatever the input
    chosen = chosen.join(F.broadcast(table), "g").where(inside).select("doc_id", "part", "n_tokens", (F.col("base") + F.floor((F.col("idx") - F.col("lo")) / F.col("a"))).cast("long").alias("container"))
    chosen = written(chosen, "chosen")
    room = chosen.groupBy("container").agg((F.lit(capacity) - F.sum("n_tokens")).cast("int").alias("room")).where("room > 0").withColumn("shard", F.pmod(F.xxhash64("container"), F.lit(shards)).cast("int"))
    small = items.where(F.col("n_tokens") <= LARGE * capacity).select("doc_id", "part", "n_tokens", "shard")
    fitted = room.groupBy("shard").cogroup(small.groupBy("shard")).applyInPandas(_best_fit(capacity, shards, base), "doc_id long, part int, n_tokens int, container long")
    return filled.unionByName(chosen).unionByName(fitted)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill): how full the containers are."""
    return packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / (F.count("*") * capacity), 6).alias("fill"), F.max("t").alias("most"))
