"""The same fold over a stream of outcomes, with the state in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators.hosts import _STATE, Control, step


def control(outcomes: DataFrame, most: int = 4, delay: float = 1.0) -> DataFrame:
    """State of each host after every micro-batch of a stream (host, at, status); outcomes count in the order of their time within a batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Control(*state.get) if state.exists else Control.start(most, delay)
        n = 0
        rows = sorted((r for b in batches for r in zip(b["at"], b["status"], b["kind"])), key=lambda r: r[:2])
        for at, _, kind in rows:
            c, n = step(c, kind, at), n + 1
        state.update(astuple(c))
        yield pd.DataFrame([{"host": key[0], "n": n} | asdict(c)])

    rows = outcomes.where("host is not null").select("host", F.col("at").cast("double").alias("at"), F.coalesce("status", F.lit("")).alias("status"), T.outcome(F.col("status")).alias("kind"))
    return rows.groupBy("host").applyInPandasWithState(update, f"host string, n long, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)
