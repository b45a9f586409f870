"""Approximate nearest neighbours: a forest of random-projection trees.

Each tree halves a sample of the vectors at the median of a projection on the
difference of two random members, until a node holds few. Every row of the
table is put into one leaf of each tree. A query walks all trees from one
shared priority queue: the branch it is on the right side of keeps its
parent's priority, the other gets the margin it fails by, and the best branch
over all trees is opened next, until the opened leaves hold ``search`` rows.
The rows of those leaves are the candidates and are ranked by their exact
inner products.

The forest is fitted on at most about ``SAMPLE`` vectors and is broadcast (its
size is bounded by the sample); all rows are indexed. A leaf's rows are cut
into blocks of about ``BLOCK`` rows, so that a vector with very many copies
does not come together in one task; queries go to every block of a leaf and
bring back their best few of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


SAMPLE, LEAF, BLOCK, TREES = 20_000, 128, 2_048, 8
#: What a fit aims at on its own sample, and the shares of the rows it tries.
AIM, SHARES = 0.955, (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0, 4.0)


class Tree:
    """Inner nodes 0..n-1 with a direction, a threshold and two children; a child under 0 is the leaf ``-child - 1``."""

    def __init__(self, directions: np.ndarray, cuts: np.ndarray, children: np.ndarray, n_leaves: int):
        self.directions, self.cuts, self.children, self.n_leaves = directions, cuts, children, n_leaves


def grow(x: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> Tree:
    directions, cuts, children, leaves = [], [], [], 0
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, parent = todo.pop()
        split = None
        if len(rows) > leaf:
            for _ in range(5):  # copies of one vector can't be parted
                a, b = rng.choice(rows, 2, replace=False)
                d = x[a] - x[b]
                size = np.linalg.norm(d)
                if size == 0:
                    continue
                z = x[rows] @ (d / size)
                at = np.median(z)
                right = z > at
                if 0 < right.sum() < len(rows):
                    split = (d / size, at, right)
                    break
        if split is None:
            here, leaves = -leaves - 1, leaves + 1
        else:
            here = len(cuts)
            directions.append(split[0])
            cuts.append(split[1])
            children.append([0, 0])
            todo += [(rows[~split[2]], (here, 0)), (rows[split[2]], (here, 1))]
        if parent is not None:
            children[parent[0]][parent[1]] = here
    dims = x.shape[1] if x.ndim == 2 else 0
    return Tree(np.array(directions).reshape(-1, dims), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), leaves)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    if not len(tree.cuts):
        return np.zeros(len(x), np.int64)
    at, inside = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(inside):
        n = at[inside]
        right = np.einsum("ij,ij->i", x[inside], tree.directions[n]) > tree.cuts[n]
        at[inside] = tree.children[n, right.astype(int)]
        inside = inside[at[inside] >= 0]
    return -at - 1


def walk(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, search: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until their rows reach ``search``."""
    margins = [t.directions @ q - t.cuts if len(t.cuts) else t.cuts for t in trees]
    queue = [(-np.inf, i, 0 if len(t.cuts) else -1) for i, t in enumerate(trees)]
    heapq.heapify(queue)
    out, rows = [], 0.0
    while queue and rows < search:
        badness, i, node = heapq.heappop(queue)
        if node < 0:
            out.append((i, -node - 1))
            rows += sizes[i][-node - 1]
            continue
        m, (left, right) = margins[i][node], trees[i].children[node]
        heapq.heappush(queue, (max(badness, -m), i, int(right)))
        heapq.heappush(queue, (max(badness, m), i, int(left)))
    return out


class Forest:
    """Trees, where each one's leaves begin in the common numbering, and the rows to open as a share of all."""

    def __init__(self, trees: list[Tree], share: float):
        self.trees, self.share = trees, share
        self.first = np.concatenate(([0], np.cumsum([t.n_leaves for t in trees])))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """One column per tree."""
        return np.stack([leaf_of(t, x) + at for t, at in zip(self.trees, self.first)], axis=1)

    def split(self, counts: np.ndarray) -> list[np.ndarray]:
        return [counts[a:b] for a, b in zip(self.first[:-1], self.first[1:])]


def fit(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, k: int = 20, seed: int = 3) -> Forest:
    """A forest over ``x``; the share is the least of ``SHARES`` whose recall against brute force over ``x`` is ``AIM``."""
    rng = np.random.default_rng(seed)
    forest = Forest([grow(x, rng, leaf) for _ in range(trees)], SHARES[-1])
    where = forest.leaves(x)
    sizes = forest.split(np.bincount(where.ravel(), minlength=forest.first[-1]))
    asked = rng.permutation(len(x))[:60]
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    kth = -np.partition(-near, min(k, len(x) - 1) - 1, axis=1)[:, min(k, len(x) - 1) - 1] if len(x) > 1 else np.zeros(len(asked))
    orders = [walk(forest.trees, sizes, x[i], SHARES[-1] * len(x)) for i in asked]
    for share in SHARES:
        found = 0.0
        for row, (i, order) in enumerate(zip(asked, orders)):
            rows = np.cumsum([sizes[t][leaf] for t, leaf in order])
            opened = order[: int(np.searchsorted(rows, max(share * len(x), 20 * k))) + 1]
            seen = np.zeros(len(x), bool)
            for t, leaf in opened:
                seen |= where[:, t] == leaf + forest.first[t]
            found += (near[row][seen] >= kth[row] - 1e-9).sum() / max(1, (near[row] >= kth[row] - 1e-9).sum())
        if found / max(1, len(asked)) >= AIM:
            forest.share = share
            break
    return forest


def usable(v: str) -> Column:
    """Vectors without null or non-finite components that are not zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(v).isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def _best(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, each vector once; ties to the smaller id."""
    order = np.lexsort((-score, v, q))
    q, v, score = q[order], v[order], score[order]
    once = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])] if len(q) else np.zeros(0, bool)
    q, v, score = q[once], v[once], score[once]
    order = np.lexsort((v, -score, q))
    q, v, score = q[order], v[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = rank < k
    return q[keep], v[keep], score[keep]


def _matched(k: int, flush: int = 400_000, step: int = 512):
    """For sorted (leaf, block, is_query) rows: each query's best of its blocks, joined over the blocks of a task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, ids, rows, x = None, [], [], None
        held: list[tuple] = []
        n = 0
        for pdf in parts:
            keys = pdf["leaf"].to_numpy() * np.int64(1 << 31) + pdf["block"].to_numpy()
            asks = pdf["is_query"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (asks[1:] != asks[:-1])]) if len(pdf) else []
            for a, b in zip(edges, [*edges[1:], len(pdf)]):
                if keys[a] != group:
                    group, ids, rows, x = keys[a], [], [], None
                some_ids, some = pdf["id"].to_numpy()[a:b], np.stack(pdf["v"].to_numpy()[a:b]).astype(float)
                if not asks[a]:
                    ids.append(some_ids)
                    rows.append(some)
                    continue
                if not rows:
                    continue
                if x is None:
                    own, x = np.concatenate(ids), np.concatenate(rows)
                for at in range(0, len(some), step):
                    q, q_ids = some[at : at + step], some_ids[at : at + step]
                    s = q @ x.T
                    s[q_ids[:, None] == own[None, :]] = -np.inf
                    kth = np.partition(s, -min(k, len(own)), axis=1)[:, -min(k, len(own))]
                    i, j = np.nonzero((s >= kth[:, None] - 1e-9) & (s > -np.inf))
                    found = _best(q_ids[i], own[j], (q[i] * x[j]).sum(1), k)
                    held.append(found)
                    n += len(found[0])
                if n > flush:
                    held = [_best(*map(np.concatenate, zip(*held)), k)]
                    n = len(held[0][0])
                    if n > flush // 2:
                        yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), held[0])))
                        held, n = [], 0
        if held:
            yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), _best(*map(np.concatenate, zip(*held)), k))))

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", v_col: str = "embedding", trees: int = TREES) -> DataFrame:
    """The ``k`` nearest found of each row that ``queries`` holds for: query_id, rank (from 1), vec_id, score.

    Nearness is the inner product in double precision. Rows without id, and
    vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part. Rows of one id are one query, by
    their smallest vector, and one candidate with the best score; a query is never its own candidate. An
    empty table gives none. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(v_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable("v") & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, most = lengths[0]
    rows = rows.where(F.size("v") == dims)
    share = min(1.0, SAMPLE / most)
    picked = rows if share >= 1 else rows.where(F.xxhash64("id", F.lit("forest")).cast("double") < F.lit((share * 2 - 1) * 2.0**63))
    forest = fit(np.array([r["v"] for r in picked.select("v").orderBy(F.xxhash64("id")).collect()], float).reshape(-1, dims), trees, k=k)
    sent = spark.sparkContext.broadcast(forest)
    n_leaves = int(forest.first[-1])

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_leaves, np.int64)
        for pdf in parts:
            if len(pdf):
                total += np.bincount(sent.value.leaves(np.stack(pdf["v"].to_numpy()).astype(float)).ravel(), minlength=n_leaves)
        yield pd.DataFrame({"leaf": np.arange(n_leaves), "n": total})

    counts = np.zeros(n_leaves, np.int64)
    for r in rows.select("v").mapInPandas(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r["leaf"]] = r["n"]  # as many rows as the forest has leaves
    sizes = forest.split(counts)
    blocks = np.maximum(1, -(-counts // BLOCK))
    search = max(forest.share * counts.sum() / max(1, trees), 20 * k)

    @F.pandas_udf("array<long>")
    def placed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(list(sent.value.leaves(np.stack(s.to_numpy()).astype(float))) if len(s) else [])

    @F.pandas_udf("array<long>")
    def walked(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = sent.value
        for s in parts:
            yield pd.Series([[int(leaf + f.first[t]) for t, leaf in walk(f.trees, sizes, np.asarray(v, float), search)] for v in s])

    cuts = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(n_leaves), "blocks": blocks}), "leaf long, blocks long")
    cuts = F.broadcast(cuts)  # a row per leaf of the forest
    index = rows.select("id", "v", F.explode(placed("v")).alias("leaf")).join(cuts, "leaf").select(
        "leaf", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(0).alias("is_query"), "id", "v"
    )
    asked = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.explode(walked("v")).alias("leaf")).join(cuts, "leaf").select(
        "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("is_query"), "id", "v"
    )
    met = index.unionByName(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "is_query")
    found = met.mapInPandas(_matched(k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
