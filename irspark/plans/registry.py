"""All queries of the core and their SQL."""

from __future__ import annotations

from . import corpus, evaluation, models, ranking, retrieval, storage, texts

_ALL = (retrieval, ranking, evaluation, corpus, texts, models, storage)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
SQL = {k: v for m in _ALL for k, v in m.SQL.items()}
