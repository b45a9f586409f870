"""The best hits of each question, inside of tasks and of tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows up to this many are broadcast; above it both sides are shuffled.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are few."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def best_of(best: pd.DataFrame | None, some: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best of each question so far; scores equal to eight places are ties, which go to the smaller id."""
    best = some if best is None else pd.concat([best, some])
    best = best.assign(r=best["score"].round(8)).sort_values(["query_id", "r", "chunk_id"], ascending=[True, False, True])
    return best.groupby("query_id").head(k).drop(columns="r")


def edge(s: np.ndarray, k: int) -> np.ndarray:
    """Each row's k-th best score, less what rounding may hide."""
    n = min(k, s.shape[1])
    return np.partition(s, -n, axis=1)[:, -n] - 1e-7


def ranked(hits: DataFrame, k: int, score: str = "score", by: str = "chunk_id", group: str = "query_id") -> DataFrame:
    """The ``k`` best of each group with ``rank`` from 1; scores equal to eight places are ties, which go to the smaller id."""
    w = Window.partitionBy(group).orderBy(F.desc(F.round(score, 8)), by)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
