"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits) are cut into segments. Two fingerprints that differ in
at most ``distance`` bits differ in at most ``distance // segments`` bits of
some segment, so looking up every segment's Hamming ball of that radius finds
every link. Of a pair the side with the smaller key in the segment asks, so each
such meeting is made once. Complete distances are verified. There are three
segments of about 21 bits, or, from ``MANY`` fingerprints on, two of 32 bits, so
that a table's entries stay few as the number of fingerprints grows.

Copies share a fingerprint and are one node, so a group of copies of any size
costs one row. A dense group of near copies has links between almost all of its
members. So a bucket's neighbours are linked first (a few for each fingerprint),
and the full search then leaves out pairs that are in one component already, so
that it gives few links; the pairs of a dense bucket are still looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small_batches, unused
from .graph import connected_components

#: (first bit, bits) of each segment, for fewer than ``MANY`` fingerprints and for more.
FEW_SEGMENTS, MANY_SEGMENTS = ((0, 22), (22, 21), (43, 21)), ((0, 32), (32, 32))
MANY = 1 << 26
BLOCK = 1 << 15
Segments = tuple[tuple[int, int], ...]


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one text; without words it is zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())
        h = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((ones * 2 > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(col: str | Column, shingle: int = 4) -> Column:
    """The fingerprint of a text column as a bigint (the same 64 bits)."""

    @F.pandas_udf("long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(np.array([simhash(t, shingle) for t in s], np.uint64).view(np.int64))

    return of(F.col(col) if isinstance(col, str) else col)


def segments_for(n: int) -> Segments:
    return FEW_SEGMENTS if n < MANY else MANY_SEGMENTS


def _key(fp: str, segment: tuple[int, int]) -> Column:
    at, bits = segment
    return F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _tables(nodes: DataFrame, segments: Segments) -> DataFrame:
    """One row per fingerprint and segment: ``s`` and the key ``k``."""
    keys = F.array(*[F.struct(F.lit(s).alias("s"), _key("fp", x).alias("k")) for s, x in enumerate(segments)])
    return nodes.select("*", F.explode(keys).alias("e")).select(*nodes.columns, "e.s", "e.k")


def _probes(nodes: DataFrame, segments: Segments, distance: int) -> DataFrame:
    """The keys of each segment's Hamming ball that are not smaller than its own, which is marked ``same``."""
    radius = distance // len(segments)
    asked = None
    for s, (at, bits) in enumerate(segments):
        masks = [sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(range(bits), r)]
        key = _key("fp", (at, bits))
        ball = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), key.bitwiseXOR)
        one = nodes.select(*nodes.columns, F.lit(s).alias("s"), key.alias("own"), F.explode(ball).alias("k")).where(F.col("k") >= F.col("own"))
        one = one.select(*nodes.columns, "s", "k", (F.col("k") == F.col("own")).alias("same"))
        asked = one if asked is None else asked.unionByName(one)
    return asked


def links(nodes: DataFrame, distance: int = 4, segments: Segments = FEW_SEGMENTS) -> DataFrame:
    """``nodes(fp[, root])`` to ``(a, b)``, pairs of other fingerprints at most ``distance`` bits apart.

    With a ``root`` column pairs of one root are left out.
    """
    a, b = _probes(nodes, segments, distance).alias("a"), _tables(nodes, segments).alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    once = ~F.col("a.same") | (F.col("a.fp") < F.col("b.fp"))
    on = (F.col("a.s") == F.col("b.s")) & (F.col("a.k") == F.col("b.k")) & once & near
    if "root" in nodes.columns:
        on = on & (F.col("a.root") != F.col("b.root"))
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def neighbour_links(nodes: DataFrame, distance: int = 4, ahead: int = 3, segments: Segments = FEW_SEGMENTS) -> DataFrame:
    """Some of the links, at most ``ahead`` for each fingerprint and segment: those to the next ones of its segment's bucket.

    The bucket is ordered by the bits that follow the segment, so members of a
    dense group come to stand beside each other.
    """
    after = F.lit(0).cast("long")
    for s, (at, bits) in enumerate(segments):
        turn = (at + bits) % 64
        turned = F.shiftrightunsigned("fp", turn).bitwiseOR(F.shiftleft("fp", 64 - turn)) if turn else F.col("fp")
        after = F.when(F.col("s") == s, turned).otherwise(after)
    w = Window.partitionBy("s", "k").orderBy(after)
    seen = _tables(nodes, segments).select("fp", F.array(*[F.lead("fp", i).over(w) for i in range(1, ahead + 1)]).alias("next"))
    return (
        seen.select(F.col("fp").alias("a"), F.explode("next").alias("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    )


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``fp`` (bigint) and ``component_id``, the smallest id reachable over links.

    Null texts and texts without words have fingerprint zero and are linked
    like any other; null ids take part and are never the smallest (a component
    of null ids only has none); repeated rows stay as often as they come; an
    empty table gives none; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col, shingle).alias("fp")))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    segments = segments_for(nodes.count())
    first = connected_components(neighbour_links(nodes.select("fp"), distance, segments=segments))
    rooted = cut(
        nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    )
    across = links(rooted, distance, segments)
    roots = connected_components(first.toDF("a", "b").union(across))
    known = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    lows = known.groupBy("root").agg(F.min("low").alias("root_low"))
    merged = known.join(lows, "root").select("fp", "root_low")
    of = nodes.join(merged, "fp", "left").select("fp", F.coalesce("root_low", "low").alias("component_id"))
    return prints.join(of, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def representatives(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; of rows with one id one stays; rows without id all stay."""
    keep, row = unused(docs, "_keep", "_row")
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), distance, id_col=id_col, text_col=text_col)
    stay = found.where(F.col(id_col) == F.col("component_id")).select(F.col("component_id").alias(keep)).distinct()
    of_id = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
    return (
        docs.join(stay, F.col(id_col) == F.col(keep), "left")
        .where(F.col(id_col).isNull() | F.col(keep).isNotNull())
        .withColumn(row, F.row_number().over(of_id))
        .where(F.col(id_col).isNull() | (F.col(row) == 1))
        .select(*docs.columns)
    )
