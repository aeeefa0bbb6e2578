"""Checks of translated queries: (qid, query, en, zh). The translating model itself is an interface, see Translator."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.kernels import diff_ratio, glossary_hits


class Translator(Protocol):
    def __call__(self, queries: list[str]) -> list[str]: ...


def translate(queries: DataFrame, done: DataFrame, load) -> DataFrame:
    """(id, raw) for the queries without a valid record, longest first. load() makes the model once per worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: Translator = load()
        for b in batches:
            b = b.sort_values("query", key=lambda s: -s.str.len())
            yield pd.DataFrame({"id": b["id"], "raw": model(b["query"].tolist())})

    return queries.join(done.select("id"), "id", "left_anti").select("id", "query").mapInPandas(run, "id long, raw string")


def best_records(records: DataFrame) -> DataFrame:
    """One record per id: valid ones before others, then the latest (file, line)."""
    w = Window.partitionBy("id").orderBy(F.desc("ok"), F.desc("file"), F.desc("line"))
    return records.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def checks(pairs: DataFrame) -> DataFrame:
    """Per query whether each translation is in its script, keeps the numbers and has no suspicious length."""
    q, n = F.col("query"), F.greatest(F.length("query"), F.lit(1))
    cols = {}
    for lang, short in (("en", 0.5), ("zh", 0.15)):
        t = F.coalesce(F.col(lang), F.lit(""))
        cols |= {f"{lang}_script": T.script_ok(t, F.lit(lang)), f"{lang}_numbers": T.numbers_kept(q, t), f"{lang}_ratio": F.length(t) / n, f"{lang}_short": F.length(t) / n < short}
    return pairs.where("query is not null").select("qid", *(v.alias(k) for k, v in cols.items()))


def summary(checks_: DataFrame) -> DataFrame:
    out = [F.count("*").alias("n")]
    for lang in ("en", "zh"):
        out += [F.count_if(f"{lang}_{k}").alias(f"{lang}_{k}") for k in ("script", "numbers", "short")] + [F.round(F.median(f"{lang}_ratio"), 6).alias(f"{lang}_ratio")]
    return checks_.agg(*out)


def glossary(lines: DataFrame) -> DataFrame:
    """(no, alias, exact, en, zh) of tab-separated lines 'alias|alias, en, zh, note'; '=' before an alias means as spelled; # comments."""
    x = lines.where("value is not null and value <> '' and not startswith(value, '#')").select(F.xxhash64("value").alias("no"), F.split("value", "\t").alias("p")).where("size(p) >= 3")
    a = x.select("no", F.explode(F.split(F.col("p")[0], r"\|")).alias("a"), F.trim(F.col("p")[1]).alias("en"), F.trim(F.col("p")[2]).alias("zh")).withColumn("a", F.trim("a"))
    return a.where("a <> '' and a <> '='").select("no", F.regexp_replace("a", "^=", "").alias("alias"), F.col("a").startswith("=").alias("exact"), "en", "zh")


def hits(queries: DataFrame, glossary_: DataFrame, most: int = 8) -> DataFrame:
    """(qid, pos, no): entries in a query, longest first and none overlapping, in text order. The glossary is a hand-written
    table; it is collected and must stay under 100,000 aliases."""
    rows = glossary_.select("alias", "exact", "no").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("glossary too large")
    entries = [(r["alias"], r["exact"], r["no"]) for r in rows]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(q, i, no) for q, t in zip(b["qid"], b["query"]) if t for i, no in enumerate(glossary_hits(t, entries, most))]
            yield pd.DataFrame(out, columns=["qid", "pos", "no"]).astype("int64")

    return queries.select("qid", "query").mapInPandas(find, "qid long, pos long, no long")


def copies(pairs: DataFrame, examples: list[tuple[str, str]], bar: float = 0.8) -> DataFrame:
    """(qid) of translations that repeat a prompt's example (query, translation) although the queries differ."""

    @F.pandas_udf("boolean")
    def copied(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([any(diff_ratio(y, et) > bar >= diff_ratio(x, eq) for eq, et in examples) for x, y in zip(q.fillna(""), t.fillna(""))])

    return pairs.where(copied("query", "en")).select("qid")


def questions_and_acronyms(pairs: DataFrame) -> DataFrame:
    """Totals: queries with several questions and translations that keep their number; acronyms and those that stand in the translations."""
    n = F.regexp_count("query", F.lit(r"\?"))
    marks = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[?？]"))
    acr = F.filter(F.array_distinct(F.split("query", r"[^\p{L}\p{N}]+")), lambda x: x.rlike("^[A-Z][A-Z0-9]+$"))
    kept = lambda c: F.size(F.filter(acr, lambda a: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lower(a))))
    x = pairs.where("query is not null")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return x.agg(
        F.count_if(n >= 2).alias("several"), F.count_if((n >= 2) & (marks(F.col("en")) >= n)).alias("en_questions"), F.count_if((n >= 2) & (marks(F.col("zh")) >= n)).alias("zh_questions"),
        total(F.size(acr)).alias("acronyms"), total(kept(F.col("en"))).alias("en_acronyms"), total(kept(F.col("zh"))).alias("zh_acronyms"),
    )


def sign_test(wins: int, losses: int) -> float:
    """Two-sided binomial probability of so uneven a result; ties don't count."""
    from math import comb

    n = wins + losses
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n) if n else 1.0


def blind_pairs(pairs: DataFrame, n: int, seed: str = "13", done: DataFrame | None = None) -> DataFrame:
    """(qid, query, left, right, swapped) of n queries for a blind comparison of translations a and b: a third from each tertile of length in
    the order of a hash, the rest where a and b differ most. Queries in done and those with equal or missing translations are left out."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff_ratio(x, y) for x, y in zip(a, b)])

    x = pairs.where("a is not null and b is not null and a <> b")
    x = x if done is None else x.join(done.select("qid"), "qid", "left_anti")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col("qid").cast("string")))
    q = x.agg(F.percentile_approx(F.length("query"), [1 / 3, 2 / 3], 10_000).alias("q"))
    x = x.withColumn("h", h).crossJoin(F.broadcast(q)).withColumn("tier", (F.length("query") > F.col("q")[0]).cast("int") + (F.length("query") > F.col("q")[1]).cast("int"))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("tier").orderBy("h"))).withColumn("alike", alike("a", "b"))
    x = x.orderBy((F.col("r") > n // 6).cast("int"), F.when(F.col("r") > n // 6, F.col("alike")).otherwise(0), "h").limit(n)
    flip = F.conv(F.left("h", F.lit(1)), 16, 10).cast("int") % 2 == 1
    return x.select("qid", "query", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("left"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("right"), flip.alias("swapped"))


def blind_result(key: DataFrame, votes: DataFrame) -> dict:
    """Wins of a and b and ties from votes (qid, better: left, right or tie, severe_left, severe_right), with the sign test's p."""
    x = key.join(votes, "qid")
    a = F.when(F.col("better") == "tie", "tie").when((F.col("better") == "left") != F.col("swapped"), "a").otherwise("b")
    r = x.agg(*(F.count_if(a == k).alias(k) for k in ("a", "b", "tie")), F.count_if(F.when(F.col("swapped"), F.col("severe_right")).otherwise(F.col("severe_left"))).alias("severe_a"), F.count_if(F.when(F.col("swapped"), F.col("severe_left")).otherwise(F.col("severe_right"))).alias("severe_b")).first().asDict()
    return r | {"p": sign_test(r["a"], r["b"])}
