"""Connected components over an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` (bigint, no nulls) to ``(node, root)``, ``root`` the smallest node of the component.

    Alternating large-star and small-star steps: each round hangs every node's
    larger neighbours on its smallest one, so the graph becomes a set of stars
    in O(log^2 n) rounds. A round is two aggregations and two joins on the
    node, with partial aggregation before the shuffle, and ends in a
    checkpoint. Self edges and repeated edges do no harm.
    """
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = _digest(now)
    while seen[0]:
        now = packed(now, seen[0])
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u")
        small = (
            hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(hung.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = cut(small)
        last, seen = seen, _digest(now)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
