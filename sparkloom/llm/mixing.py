"""Mixing sources to target weights by systematic sampling.

Sources share the mixture's size by weight, none above a multiple of its own
size. Within a source every document expects target / size copies; the
expected copies are summed along the source in the order of document size,
one random offset is added, and a document is emitted once for each integer
that its share of the sum crosses. Documents of like size stand together, so
the words taken stay near the target.

A source may hold a third of all rows, so no window spans one: the place of a
document is the number of smaller ones (a histogram of sizes), plus those of
its size in earlier of ``SALTS`` hash ranges, plus its place within its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import blank_split, cut, unused

#: Hexadecimal digits of a document's digest that make its range.
SALT_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` to those and ``target``.

    Sources in code-point order, null last, get the weights in turn. The total
    is ``share`` of all sizes; a target stops at ``most`` times its source's
    size and what it leaves is shared again by weight. In the order of
    size / weight a source is full when the level that the ones before it
    leave reaches its own limit, so one pass in that order finds all of them.
    The windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights)))).cast("double")
    ranked = sizes.withColumn("w", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(ever) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    over = F.sum("w").over(ever) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / over)
    capped = F.col("full") / F.col("w") <= F.col("level")
    final = F.max(F.when(~capped, F.col("level"))).over(ever)
    return leveled.withColumn("target", F.when(capped, F.col("full")).otherwise(final * F.col("w"))).select("source", "source_size", "target")


def _unit(text: Column) -> Column:
    """A number from 0 to below 1, a multiple of 2 ** -32, from a text's digest."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, tk, size, source_size, target, copies.

    ``size`` counts words; a null text has none. Null sources are one source,
    the last. Null ids and repeated rows are documents of their own. An empty
    table, or one without words, takes nothing. The same rows and seed give
    the same copies. Other columns are not looked at.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    slim = cut(
        docs.select(
            "doc_id", "source", F.xxhash64("text").alias("tk"),
            F.coalesce(F.size(blank_split(F.col("text"))), F.lit(0)).cast("long").alias("size"), digest.alias("d"),
        ).withColumn("salt", F.substring("d", 1, SALT_DIGITS))
    )
    cells = slim.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    total = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(total, weights, share, most).withColumn(
        "u", _unit(F.concat_ws("|", F.lit(f"offset {seed}"), F.col("source")))
    )
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    placed = by_size.select("source", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base"))
    sized = placed.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "g.source_size", "g.target", "g.u")
    earlier = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cells.select("source", "size", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("more"))
    at = ranges.alias("r").join(sized.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.size") == F.col("s.size"))).select(
        "r.source", "r.size", "r.salt", (F.col("base") + F.col("more")).alias("before"), "source_size", "target", "u"
    )
    within = Window.partitionBy("source", "size", "salt").orderBy("d", "doc_id", "tk")
    ranked = slim.withColumn("rn", F.row_number().over(within)).alias("d").join(
        at.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.size") == F.col("a.size")) & (F.col("d.salt") == F.col("a.salt"))
    )
    rank = (F.col("before") + F.col("rn")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("u") + rate * rank) - F.floor(F.col("u") + rate * (rank - 1))
    return ranked.select(
        "d.doc_id", "d.source", "tk", "d.size", "source_size", "target", F.least(crossed, F.ceil(F.lit(float(most)))).cast("int").alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn, with all their columns, whatever their names.

    Texts and ids may be null; rows without words come as often as others of
    their source (never, if none has words), and nothing comes of an empty
    table. Rows equal in id, text and source are told apart by their number
    only.
    """
    tk, i, own, t, n, copies, copy = unused(docs, "_tk", "_i", "_id", "_t", "_n", "_copies", "_copy")
    key = Window.partitionBy("doc_id", "tk").orderBy(F.col("source").asc_nulls_last(), "copies")
    drawn = draw(docs, weights, share, most, seed).withColumn("place", F.row_number().over(key)).where("copies > 0")
    drawn = drawn.select(F.col("doc_id").alias(own), F.col("tk").alias(t), F.col("place").alias(n), F.col("copies").alias(copies))
    same = Window.partitionBy("doc_id", tk).orderBy(F.col("source").asc_nulls_last())
    rows = docs.withColumn(tk, F.xxhash64("text")).withColumn(i, F.row_number().over(same))
    on = F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(tk) == F.col(t)) & (F.col(i) == F.col(n))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return rows.join(drawn, on).select(*kept, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(*kept)
