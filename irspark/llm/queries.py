"""Registered queries of this subpackage: problem N's are named pN_..."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import borda, consensus, language, leak, near, packing, pages, repeats, topn
from .common import table

_GROUP = ["branch", "qid"]


def _top(spark: SparkSession, sf: str) -> DataFrame:
    path = topn.cluster(table(spark, sf, "runs"), _GROUP, "unit_id", "score")
    return topn.top_n(spark, path, _GROUP, "unit_id", "score", 10)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select(*_GROUP, "unit_id")


def p1_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf).select(*_GROUP, "unit_id", F.round(F.col("score").cast("double"), 4).alias("score"), F.col("place").cast("long").alias("place"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.found(table(spark, sf, "corpus"))


def p2_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Every text without its site lines."""
    return repeats.cleaned(table(spark, sf, "corpus")).select("id", "host", "text", F.col("n_cut").cast("long").alias("n_cut"))


def p3_borda(spark: SparkSession, sf: str) -> DataFrame:
    """One order of the units of every query."""
    return borda.borda(table(spark, sf, "runs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return pages.frame_lines(table(spark, sf, "pages"))


def p4_main(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's main body."""
    return pages.blocks(table(spark, sf, "pages")).select("id", "session", "main")


def _near(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, cut = near.project_rows(table(spark, sf, "corpus"), table(spark, sf, "relevant_chunks"))
    return near.near(rows, cut)


def _tab() -> F.Column:
    return F.when(F.col("tab") == 0, near.TABS[0]).otherwise(near.TABS[1]).alias("tab")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return near.all_pairs(*_near(spark, sf)).select(_tab(), "id_a", "id_b")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with its copies, links and group."""
    return near.groups(*_near(spark, sf)).select(_tab(), "id", "rep", "copies", "links", "class_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return consensus.contradicted(table(spark, sf, "labels"), table(spark, sf, "judge_key"), table(spark, sf, "qrels"))


def p6_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Consensus grade of every item by qid and unit."""
    items, _ = consensus.model(consensus.answers(table(spark, sf, "labels")))
    return consensus.consensus(items).join(table(spark, sf, "judge_key").select("item", "qid", "unit_id").distinct(), "item")


def p6_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Expected accuracy of every labeler with its interval."""
    return consensus.reliability(*consensus.model(consensus.answers(table(spark, sf, "labels"))))


def p6_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Krippendorff's alpha."""
    return consensus.krippendorff(consensus.answers(table(spark, sf, "labels")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return pages.found_residue(table(spark, sf, "pages"))


def p7_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the classifiers on hosts that they weren't fitted on."""
    return pages.validation(table(spark, sf, "pages"))


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Every text, or piece of an oversized one, with its container."""
    return packing.pack(packing.token_counts(table(spark, sf, "documents")))


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p8_pack(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.found(table(spark, sf, "eval_items"), table(spark, sf, "documents"))


def p9_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches that share wording with an item, with the state of its placeholders."""
    return leak.matches(table(spark, sf, "eval_items"), table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return language.found(table(spark, sf, "documents"))


def p10_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch in one language with its confidence."""
    return language.stretches(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_top10, p2_found, p2_cleaned, p3_borda, p4_found, p4_main, p5_found, p5_groups, p6_found, p6_consensus, p6_reliability,
        p6_agreement, p7_found, p7_validation, p8_pack, p8_fill, p9_found, p9_matches, p10_found, p10_stretches,
    )
}
