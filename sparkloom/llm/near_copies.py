"""Near copies: all pairs of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

The links are those of the exact set-similarity join, not of a sketch. Every
text's shingles are put into one order for all texts; two texts that are
similar enough share a shingle among the first n - ceil(0.8 n) + 1 of each. What
meets there is checked for size, for the overlap its places leave possible, and
for the parities of the hashes (none of these loses a pair), and then word by word. Shingles that many texts of a sample hold come last in
the order, so that few texts meet at any one: the sample decides on speed only,
as every order finds every pair.

SimHash goes first, by the multi-index search of ``simhash``: fingerprints of the
shingles that differ in at most 4 bits, neighbours in a bucket ahead of all
others. It finds most links; each is verified on the words. Texts of similarity
0.8 differ in about 10 of 64 bits, so the links that it can't see are the
set-similarity join's.

A dense group has links between almost all of its members. So in rounds, of each
component that meets at a shingle one text, another in each round, is compared
with that of the next component, in the order of size and five-word SimHash, and
(from the second round on) with that of the one with most texts there, if their
SimHash is near enough for a link to be likely; what is similar becomes one
component, until a round finds nothing. The full search then leaves out pairs
that are in one component already, and nothing else. Texts of the same words are one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import cut, packed, shuffles_dropped, small_batches, stored, unused
from .graph import connected_components

SHINGLE = 5
#: Longs of every text's parity sketch. A text of more than ``64 * WIDE`` shingles also has a wide one, of at least a bit for each shingle.
WIDE = 8
PARITY = [f"s{i}" for i in range(WIDE)]
#: Up to so many texts that candidates name are found by a broadcast of their counted ids; beyond it by a shuffle of the texts.
BROADCAST_ROWS = 1_000_000
#: Up to so many pairs and links go to nodes and roots by a broadcast.
FEW_LINKS = 200_000
SAMPLE, SEEN, MOST_HEAVY = 4_000, 3, 200_000
#: Bits in which linked fingerprints differ at most.
BITS = 4
#: Rounds of comparing neighbours, of which SimHash differs in so many bits at most; what they leave is the full search's work.
ROUNDS, LIKELY_BITS = 4, 18


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> set[bytes]:
    """The different shingles; a shorter text is one shingle."""
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def similar(a: str | None, b: str | None) -> bool:
    """Whether the Jaccard similarity is 0.8 or more; texts without words are similar to each other."""
    x, y = shingles(words_of(a)), shingles(words_of(b))
    both = len(x & y)
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each different shingle, ascending: equal for equal shingles."""
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h = _mixed(h + w[i : i + n] + np.uint64(i + 1))
    return np.unique(h)


def _simhash(h: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((ones * 2 > len(h)).astype(np.uint8), bitorder="little").view(np.int64)[0])


def _parity(h: np.ndarray) -> tuple[list[int], np.ndarray | None]:
    """One bit for each place of ``64 * WIDE``: whether an odd number of hashes falls there; and for longer texts the same over more places, a power of two times as many.

    A wide sketch becomes one of fewer places by exclusive or of its parts.
    """
    wide = max(1, -(-len(h) // (64 * WIDE)) - 1).bit_length() if len(h) > 64 * WIDE else 0
    places = 64 * WIDE << wide
    odd = np.bincount((h % np.uint64(places)).astype(np.int64), minlength=places) & 1
    longs = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return np.bitwise_xor.reduce(longs.reshape(-1, WIDE), axis=0).tolist(), longs if wide else None


def _heavy(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles that several texts of a sample hold, from the rarest on."""
    every = max(1, docs.count() // SAMPLE)
    key = F.xxhash64(text_col)
    some = docs.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).select(F.col(text_col).alias("text"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for t in pdf["text"]:
                yield pd.DataFrame({"h": hashes(words_of(t)).view(np.int64)})

    often = some.distinct().mapInPandas(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    found = often.orderBy(F.desc("n"), "h").limit(MOST_HEAVY).toPandas()
    return found["h"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: the digest of its words, the number of its shingles, SimHash, the first of the shingles and the parities of all."""
    heavy = _heavy(docs, text_col)
    rank = np.argsort(heavy)
    known = heavy[rank]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for i, tk, t in zip(pdf["node"], pdf["tk"], pdf["text"]):
                words = words_of(t)
                h = hashes(words)
                n = len(h)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    last = np.where(known[at] == h, rank[at] + 1, 0)
                    ordered = h[np.lexsort((h, last))]
                else:
                    ordered = h
                first = ordered[: n - (4 * n + 4) // 5 + 1]
                parity, wide = _parity(h)
                out.append((i, tk, hashlib.md5(b" ".join(words)).digest(), n, _simhash(h), first.view(np.int64), wide, *parity))
            yield pd.DataFrame(out, columns=["node", "tk", "digest", "size", "fp", "first", "wide", *PARITY])

    rows = docs.select(F.col(id_col).alias("node"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    schema = "node long, tk long, digest binary, size int, fp long, first array<long>, wide array<long>"
    return rows.mapInPandas(run, schema + "".join(f", {c} long" for c in PARITY))


def _apart(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Different parities of two rows, whose columns ``a`` and ``b`` give."""
    return sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in PARITY), F.lit(0))


def _possible(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether sizes and parities allow a similarity of 0.8: each shingle of only one text changes one parity, and at most a ninth of the sum are such."""
    sizes = 5 * F.least(a("size"), b("size")) >= 4 * F.greatest(a("size"), b("size"))
    return sizes & (9 * _apart(a, b) <= a("size") + b("size"))


def _still_possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that the wide sketches allow as well; nodes without one pass."""
    wide = nodes.where("wide is not null").select("node", "size", "wide")
    x, y = (wide.select(F.col("node").alias(c), F.struct("size", "wide").alias(f"w{c}")) for c in "ab")

    def folded(longs: Column, n: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.aggregate(F.sequence(i, F.size(longs) - 1, n), F.lit(0).cast("long"), lambda s, k: s.bitwiseXOR(F.get(longs, k))),
        )

    n = F.least(F.size("wa.wide"), F.size("wb.wide"))
    bits = F.zip_with(folded(F.col("wa.wide"), n), folded(F.col("wb.wide"), n), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    apart = F.aggregate(bits, F.lit(0), lambda s, k: s + k)
    fits = F.when(F.col("wa").isNotNull() & F.col("wb").isNotNull(), 9 * apart <= F.col("wa.size") + F.col("wb.size")).otherwise(F.lit(True))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(fits).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, own: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar, by their texts ``(node, tk, text)``; only texts of pairs are moved."""

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b)], dtype=bool)

    n = pairs.count()
    if not n:
        return pairs
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    met = cut(own.join(F.broadcast(asked) if n <= FEW_LINKS else asked, "node", "left_semi"))
    n = met.count()
    met = F.broadcast(met) if n <= BROADCAST_ROWS else packed(met, n)
    texts = stored(texts.join(met, ["node", "tk"]).select("node", "text").dropDuplicates(["node"]))
    named = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return named.where(check("ta", "tb")).select("a", "b")


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(node, tk, low)`` for each id, ``low`` the smallest id of its words, and ``(node, root)`` of those, the components' smallest.

    ``tk`` tells which text stands for an id that has several.
    """
    made = stored(_sketches(docs, id_col, text_col))
    of_id = made.groupBy("node").agg(F.min(F.struct("tk", "digest")).alias("x")).select("node", "x.tk", "x.digest")
    names = cut(of_id.withColumn("low", F.min("node").over(Window.partitionBy("digest"))).select("node", "tk", "low"))
    own = names.where("node = low").select("node", "tk")
    nodes = stored(made.join(own, ["node", "tk"]).dropDuplicates(["node", "tk"]).select("node", "size", "fp", "first", "wide", *PARITY))
    texts = docs.select(F.col(id_col).alias("node"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    met = nodes.select("node", "size", "fp", F.posexplode("first").alias("at", "k"))
    met = stored(met.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("n > 1").drop("n"))
    sketch = nodes.select("node", "size", *PARITY)
    roots = own.select("node", F.col("node").alias("root"))
    tested = linked = None

    def meetings() -> DataFrame:
        """Rows of shingles at which different components meet."""
        rooted = met.join(roots, "node")
        several = rooted.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("k")
        return rooted.join(several, "k")

    def verified(pairs: DataFrame) -> tuple[int, DataFrame]:
        """How many of ``pairs`` not tested yet are similar, and these; they are kept as links."""
        nonlocal tested, linked
        pairs = pairs.distinct() if tested is None else pairs.distinct().join(tested, ["a", "b"], "left_anti")
        pairs = cut(_still_possible(pairs, nodes))
        pairs = packed(pairs, pairs.count())
        tested = pairs if tested is None else tested.union(pairs)
        found = cut(_verified(pairs, texts, own))
        n = found.count()
        found = packed(found, n)
        linked = found if linked is None else linked.union(found)
        return n, found

    def joined(pairs: DataFrame) -> tuple[int, DataFrame]:
        """How many of ``pairs`` not tested yet are similar, and roots that these bring together.

        Each root goes to the smallest one beside it, and on to that one's; of a
        longer chain several roots stay, which costs later rounds some pairs. The
        components themselves are made of all links in the end.
        """
        n, found = verified(pairs)
        if not n:
            return 0, roots
        light = F.broadcast if n <= FEW_LINKS else lambda df: df
        ends = light(light(found).join(roots.toDF("a", "ra"), "a")).join(roots.toDF("b", "rb"), "b").where("ra <> rb")
        step = cut(ends.groupBy(F.greatest("ra", "rb").alias("root")).agg(F.min(F.least("ra", "rb")).alias("to")))
        step = packed(step, n)
        step = step.join(light(step.toDF("to", "on")), "to", "left").select("root", F.coalesce("on", "to").alias("to"))
        return n, stored(roots.join(light(step), "root", "left").select("node", F.coalesce("to", "root").alias("root")))

    # SimHash: one text for each fingerprint, the others of the same one beside it
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    segments = simhash.segments_for(prints.count())

    def named(found: DataFrame) -> DataFrame:
        x, y = prints.toDF("a", "x"), prints.toDF("b", "y")
        return found.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    same = nodes.select("fp", F.col("node").alias("b")).join(prints.withColumnRenamed("node", "a"), "fp").where("a < b").select("a", "b")
    _, roots = joined(named(simhash.neighbour_links(prints.select("fp"), BITS, segments=segments)).union(same))
    rooted = cut(prints.join(roots, "node").select("fp", "root"))
    _, roots = joined(named(simhash.links(rooted, BITS, segments)))
    for turn in range(ROUNDS):
        first = meetings().groupBy("k", "root").agg(
            F.min_by(F.struct("size", "fp", "node"), F.xxhash64("node", F.lit(turn))).alias("x"), F.count(F.lit(1)).alias("members"),
        )
        follows, largest = Window.partitionBy("k").orderBy("x.size", "x.fp", "x.node"), Window.partitionBy("k").orderBy(F.desc("members"), "root")
        beside = first.select("x", F.lead("x").over(follows).alias("next"), (F.first("x").over(largest) if turn else F.lit(None)).alias("hub")).select("x", F.explode(F.array("next", "hub")).alias("y")).where("y is not null and x.node <> y.node")
        beside = beside.where(5 * F.least("x.size", "y.size") >= 4 * F.greatest("x.size", "y.size"))
        beside = beside.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= LIKELY_BITS)
        pairs = beside.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        rooted = sketch.join(roots, "node")
        x, y = (rooted.select(F.col("node").alias(c), F.struct("root", "size", *PARITY).alias(f"s{c}")) for c in "ab")
        def told(z: Column) -> Column:
            return F.struct(F.least(z["sa"]["root"], z["sb"]["root"]).alias("one"), F.greatest(z["sa"]["root"], z["sb"]["root"]).alias("two"), F.struct(_apart(z["sa"].getField, z["sb"].getField).alias("apart"), z["a"].alias("a"), z["b"].alias("b")).alias("p"))

        # inside of an array, as the optimizer takes very long to reason about the condition on rows
        kept = F.filter(F.array(F.struct("a", "b", "sa", "sb")), lambda z: _possible(z["sa"].getField, z["sb"].getField))
        near = pairs.join(x, "a").join(y, "b").select(F.explode(F.transform(kept, told)).alias("z")).select("z.*")
        # of two components' pairs the most alike
        n, roots = joined(near.groupBy("one", "two").agg(F.min("p").alias("p")).select("p.a", "p.b"))
        if not n:
            break
    # all others
    left = meetings().join(sketch.drop("size"), "node")
    a, b = left.alias("a"), left.alias("b")
    room = 9 * F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) >= 4 * (F.col("a.size") + F.col("b.size"))
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _possible(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")) & room
    verified(a.join(b, on).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    step = connected_components(linked)
    return names, stored(own.select("node").join(step, "node", "left").select("node", F.coalesce("root", "node").alias("root")))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component of near copies, that of the smallest id.

    Of rows with one id one counts and may stay; rows without id all stay;
    texts without words are copies of each other. An empty table gives none, and
    other columns pass through.
    """
    i, tk, row = unused(docs, "_id", "_tk", "_row")
    small_batches(docs.sparkSession)
    with shuffles_dropped(docs.sparkSession):  # what the search gives is written by then
        names, roots = links(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    gone = roots.where("node <> root").select(F.col("node").alias("low"))
    stay = names.where("node = low").join(gone, "low", "left_anti").select(F.col("node").alias(i), F.col("tk").alias(tk))
    stay = docs.join(stay, (F.col(id_col) == F.col(i)) & (F.xxhash64(text_col) == F.col(tk)), "left_semi")
    # rows of one id and one text
    one = stay.withColumn(row, F.row_number().over(Window.partitionBy(id_col).orderBy(F.lit(0)))).where(F.col(row) == 1).drop(row)
    return one.unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
