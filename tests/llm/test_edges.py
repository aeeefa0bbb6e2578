"""Empty tables, nulls in every column, empty and very long texts, repeated rows, and columns whose names clash with the operators' own."""

import pytest

from irspark import schemas
from irspark.llm import queries

TABLES = {
    "pages": schemas.PAGES, "corpus": schemas.CORPUS, "queries": schemas.QUERIES, "runs": "branch string, " + schemas.RUN, "labels": schemas.LABELS,
    "relevant_chunks": "chunk_id long, qid long, pos int, doc_id long, chunk_text string", "judge_key": "qid long, unit_id string, doc_id long, src string, item string, lang string, assigned string",
    "qrels": "qid long, unit_id string, doc_id long, lang string, grade int, n_labelers int, src string, text string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, title string, doc_type string, fetched_at timestamp", "eval_items": "item_id long, lang string, kind string, text string",
}
#: Names that the operators use themselves.
CLASH = ("hk", "lh", "g", "b", "i", "s", "n", "_cut", "_id", "key", "rep", "copies", "label", "kind_", "place", "count", "file", "shard", "part", "container", "words", "tab", "grp", "cls", "weak", "phrase", "g_0", "_g1", "_item")


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


def values(column: str, kind: str, long: str):
    if kind == "string":
        text = {"text": [None, "", " ", "\n\n", "# only a heading", "a", long, "Một câu ngắn. A short sentence that stands here for the test.", "\U0001d400𠀀 \x00 ﷺ"], "chunk_text": [None, "", "x", long], "session": [None, "s"], "status": [None, "ok", "notice"], "unit_id": [None, "1_p0", "2_p0"], "branch": [None, "x"], "item": [None, "i1"], "labeler": [None, "A", "B", "C"], "host": [None, "h"], "lang": [None, "", "vi", "en-GB", "??"]}
        return text.get(column, [None, "", "v"])
    if kind == "timestamp":
        return [None]
    if kind == "float":
        return [None, float("nan"), float("-inf"), float("inf"), 1.0, 1.0, -2.5]
    return [None, 1, 1, 2, 3]


@pytest.fixture(scope="module")
def nasty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("nasty")
    long = "từ dài không có điểm dừng " * 20_000 + "字" * 30_000
    for name, schema in TABLES.items():
        cols = [c.split() for c in schema.split(", ")]
        vals = [values(c, k, long) for c, k in cols]
        rows = [tuple(v[i % len(v)] for v in vals) for i in range(18)]
        rows += [tuple(None for _ in cols)] + [tuple(v[-1] for v in vals)] * 3
        df = spark.createDataFrame(rows, schema)
        have = {c for c, _ in cols}
        df.selectExpr("*", *(f"cast(7 as int) as {c}" for c in CLASH if c not in have)).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    rows = queries.QUERIES[name](spark, empty).collect()
    assert len(rows) == (1 if name in ("p6_agreement", "p8_fill") else 0)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_nasty(spark, nasty, name):
    queries.QUERIES[name](spark, nasty).collect()
