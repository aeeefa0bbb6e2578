"""Queries of the subpackage that SQL can express, on the smallest test data."""

from pathlib import Path

import pytest
from side_by_side import connect, rows

from irspark.llm import queries, sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in sql.SQL:
        assert rows(got) == rows(con.execute(sql.SQL[name]).df())
    elif name not in ("p9_found", "p9_matches", "p2_cleaned"):
        assert len(got)


def test_nothing_else_imports_the_subpackage():
    root = Path(__file__).resolve().parents[2] / "irspark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "irspark.llm" not in f.read_text() and "from ..llm" not in f.read_text() and "from .llm" not in f.read_text()
