"""Documents to parents and children, and what changes between two runs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import ChunkConfig, chunk, parse_marked
from ..functions.text import to_plain
from ..session import shuffles_deleted, written

#: Stands for the end of any text.
END = 2**31 - 1
_OUT = "doc_id long, lang string, doc_type string, unit_id string, char_start int, char_end int, text string, ctx string, n_tokens int, h string, parent_id string"


def units(documents: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Parents (parent_id null) and children of documents (doc_id, lang, doc_type, title, text). Each document is cut by itself."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _OUT.split(", ")]
        for b in batches:
            rows = []
            for d in b.itertuples(index=False):
                parents, children = chunk(d.doc_id, d.title, d.text, config)
                rows += [{"doc_id": d.doc_id, "lang": d.lang, "doc_type": d.doc_type, "parent_id": None} | r for r in (*parents, *children)]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "int64", "char_start": "int32", "char_end": "int32", "n_tokens": "int32"}) if rows else pd.DataFrame({n: [] for n in names}).astype({"doc_id": "int64"})

    cols = [F.col("doc_id").cast("long").alias("doc_id"), "lang", "doc_type", "title", "text"]
    return documents.where("doc_id is not null and text is not null").select(*cols).mapInPandas(cut, _OUT)


def parents(u: DataFrame) -> DataFrame:
    return u.where("parent_id is null").drop("parent_id")


def children(u: DataFrame) -> DataFrame:
    return u.where("parent_id is not null")


def invariant_violations(u: DataFrame, documents: DataFrame, rounds: int = 4) -> DataFrame:
    """(problem, unit_id): units whose text isn't at their place of the plain text, that overlap, that leave out letters of their document
    or parent, or whose parent doesn't hold them. Where no unit is to blame, unit_id is the document's: letters but no units, or a plain
    text that isn't what the markers' removal gives. Units and texts meet in rounds of documents, whose shuffle files are deleted.
    """

    @F.pandas_udf("string")
    def plain(t: pd.Series) -> pd.Series:
        return t.map(lambda x: parse_marked(x)[0])

    spans = u.select("doc_id", "parent_id", "unit_id", "char_start", "char_end").distinct()
    p = parents(spans).select(F.col("unit_id").alias("parent_id"), F.col("char_start").alias("ps"), F.col("char_end").alias("pe"))
    w = Window.partitionBy("doc_id", "parent_id").orderBy("char_start", "char_end", "unit_id")
    before, last = F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("unit_id").over(w).isNull()
    s = written(spans.join(p.hint("merge"), "parent_id", "left").withColumns({"before": before, "last": last}), "spans")
    found = lambda x, where, problem: x.where(where).select(F.lit(problem).alias("problem"), "unit_id")
    outside = found(children(s), "ps is null or char_start < ps or char_end > pe", "child outside its parent")
    overlaps = found(s, "char_start < before", "units overlap")

    # what must be the text of a unit, and what may only be white space: before each unit of a document or parent and after the last
    none = F.lit(None).cast("string")
    own = u.select("doc_id", "unit_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"), F.coalesce("text", F.lit("")).alias("want"))
    lead = s.select("doc_id", "unit_id", F.coalesce("before", "ps", F.lit(0)).alias("a"), F.col("char_start").alias("b"), none.alias("want")).where("b > a")
    tail = s.where("last and (pe is null or pe > char_end)").select("doc_id", "unit_id", F.greatest("char_end", "before").alias("a"), F.coalesce("pe", F.lit(END)).alias("b"), none.alias("want"))
    d = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), plain("text").alias("plain"), to_plain(F.col("text")).alias("shown")).select("doc_id", "plain", (F.col("plain") != F.col("shown")).alias("differs"))
    checks = own.unionByName(lead).unionByName(tail)
    got = F.expr("substring(plain, a + 1, b - a)")
    misplaced = F.when((F.col("a") < 0) | ~got.eqNullSafe(F.col("want")), "text not at its place")
    letters = F.when(got.rlike(r"(?U)\S"), "letters outside the units")
    problem = F.when(F.col("unit_id").isNull(), F.when(F.col("plain") != "", "letters outside the units")).when(F.col("want").isNotNull(), misplaced).otherwise(letters)
    # once a document: in the row after its last parent, or where it has none
    whole = F.when((F.col("unit_id").isNull() | (F.col("want").isNull() & (F.col("b") == END))) & F.col("differs"), F.struct(F.lit("plain text differs").alias("problem"), F.col("doc_id").cast("string").alias("unit_id")))
    one = F.when(problem.isNotNull(), F.struct(problem.alias("problem"), F.coalesce("unit_id", F.col("doc_id").cast("string")).alias("unit_id")))
    out = [outside, overlaps]
    with shuffles_deleted(u.sparkSession):
        for i in range(rounds):
            now = F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i
            x = checks.where(now).join(d.where(now), "doc_id", "full")
            out.append(written(x.select(F.explode(F.array_compact(F.array(one, whole))).alias("v")).select("v.*"), "violations"))
    return reduce(DataFrame.unionByName, out)


def pending(current: DataFrame, encoded: DataFrame) -> DataFrame:
    """Units that must be encoded: (unit_id, h) that isn't in encoded."""
    return current.join(encoded.select("unit_id", "h").distinct(), ["unit_id", "h"], "left_anti")


def still_valid(encoded: DataFrame, current: DataFrame) -> DataFrame:
    """Encoded rows whose text is the current one; the first block wins."""
    kept = encoded.join(current.select("unit_id", "h"), ["unit_id", "h"], "left_semi")
    row = F.struct(*(F.col(c) for c in encoded.columns))
    return kept.groupBy("unit_id").agg(F.min_by(row, "block").alias("r")).select("r.*")


def block_fingerprints(rows: DataFrame, block: Column) -> DataFrame:
    """(block, n, fingerprint): changes if any (unit_id, h) of a block does; an order-free sum, so no block is gathered."""
    return rows.groupBy(block.alias("block")).agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.left(F.md5(F.concat_ws(":", "unit_id", "h")), F.lit(12)), 16, 10).cast("long")).alias("fingerprint"))
