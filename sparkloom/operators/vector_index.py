"""A vector index in cells: every vector lies in the cell of its nearest centre, a question opens the nearest cells.

The centres come from k-means over a sample of at most ``SAMPLE`` vectors; all
vectors are assigned. How many cells a question opens (``probes``) is measured
when the index is made: the least number that finds ``RECALL`` of the true
nearest ones of sampled vectors, searched for in the sample. Cells are folders,
so cells that no question opens are not read; a tenant's vectors are looked at
for its own questions only, before any ranking.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..sources.scratch import exists, kept_path, scratch
from .rank import best_of, edge, ranked

#: Vectors that the centres are fitted to, and questions that probes are measured with, at most.
SAMPLE, TRIALS = 20_000, 400
#: Vectors of a cell on average, and cells at most.
CELL, MOST_CELLS = 256, 4_096
RECALL, NEAREST = 0.95, 10
#: Questions up to this many are sent to all tasks; more are dealt out to the cells that they open, with the same hits.
QUESTIONS = 20_000
#: Scores in memory at a time; parts of a cell that are searched apart when questions are dealt out.
SCORES, SALTS = 1 << 21, 8


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    probes: int
    recall: float
    measure: str
    tenant: str | None
    schema: str

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, owner string, cell int").parquet(f"{self.path}/vectors")

    def opened(self, questions: np.ndarray) -> np.ndarray:
        """The cells that each question opens."""
        return np.argsort(-_near(_unit(questions, self.measure), self.centres, self.measure), axis=1, kind="stable")[:, : self.probes]


def _unit(x: np.ndarray, measure: str) -> np.ndarray:
    if measure != "cosine":
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _near(q: np.ndarray, centres: np.ndarray, measure: str) -> np.ndarray:
    """Larger is nearer; by inner product for that measure, else by distance."""
    dot = q @ centres.T
    return dot if measure == "ip" else 2 * dot - (centres**2).sum(1)[None, :]


def _scores(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    s = q @ x.T
    if measure == "l2":
        s = -np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * s))
    return s


def usable(vectors: DataFrame, dims: int | None = None) -> Column:
    """Whether a vector is there, has finite entries, is of the right length, and not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return F.coalesce(fine if dims is None else fine & (F.size(v) == dims), F.lit(False))


def build(vectors: DataFrame, path: str | None = None, measure: str = "cosine", tenant: str | None = None, cells: int | None = None, recall: float = RECALL, seed: int = 7) -> VectorIndex:
    """``vectors(chunk_id, embedding, ...)`` to an index in a folder.

    Vectors that are null, zero, of another length than most, or hold null or
    non-finite entries are not indexed. Measures: cosine, ip, l2.
    """
    spark, path = vectors.sparkSession, path or scratch(vectors.sparkSession, "vectors")
    lengths = vectors.where(usable(vectors)).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dims, n = (lengths["d"], lengths["n"]) if lengths else (1, 0)
    fit = vectors.where(usable(vectors, dims)).select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = fit.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(SAMPLE).collect()
    x = _unit(np.array([r["embedding"] for r in rows], float).reshape(len(rows), dims), measure)
    k = min(cells or max(1, n // CELL), MOST_CELLS, max(1, len(rows)))
    if k > 1:
        local = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").select(array_to_vector("v").alias("features"))
        model = KMeans(k=k, seed=seed, maxIter=12, initSteps=2).fit(local)
        centres = np.array(model.clusterCenters())
    else:
        centres = x[:1] if len(x) else np.zeros((1, dims))
    probes, found = _probes(x, centres, measure, recall)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    index = VectorIndex(spark, path, centres, probes, found, measure, tenant, own)
    _assigned(vectors.where(usable(vectors, dims)), index).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    told = {"centres": centres.tolist(), "probes": probes, "recall": found, "measure": measure, "tenant": tenant, "schema": own}
    spark.range(1).select(F.lit(json.dumps(told)).alias("told")).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    told = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return VectorIndex(spark, path, np.array(told["centres"]), told["probes"], told["recall"], told["measure"], told["tenant"], told["schema"])


def kept_index(vectors: DataFrame, **how) -> VectorIndex:
    """As ``build``, once for the files that ``vectors`` are read from."""
    spark = vectors.sparkSession
    path = kept_path(vectors, f"cells-1-{'-'.join(vectors.columns)}-{'-'.join(f'{a}={b}' for a, b in sorted(how.items()))}")
    if exists(spark, f"{path}/manifest/_SUCCESS"):
        return open_index(spark, path)
    return build(vectors, path, **how)


def _probes(x: np.ndarray, centres: np.ndarray, measure: str, recall: float) -> tuple[int, float]:
    """The least number of cells that finds ``recall`` of the nearest sampled vectors of ``TRIALS`` of them, and what it finds."""
    if len(x) < 2 or len(centres) < 2:
        return len(centres), 1.0
    q = x[:TRIALS]
    s = _scores(q, x, measure)
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf  # not themselves
    nearest = np.argsort(-s, axis=1, kind="stable")[:, : min(NEAREST, len(x) - 1)]
    cell = np.argmax(_near(x, centres, "l2"), axis=1)
    place = np.argsort(np.argsort(-_near(q, centres, measure), axis=1, kind="stable"), axis=1, kind="stable")
    at = np.take_along_axis(place, cell[nearest], axis=1)
    for probes in range(1, len(centres) + 1):
        found = float((at < probes).mean())
        if found >= recall:
            return probes, found
    return len(centres), 1.0


def _assigned(vectors: DataFrame, index: VectorIndex) -> DataFrame:
    """Vectors with the cell of their nearest centre and their ``owner``."""
    sent = index.spark.sparkContext.broadcast(index.centres)
    measure = index.measure
    owner = F.col(index.tenant).cast("string") if index.tenant else F.lit(None).cast("string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _matrix(part.column("v"), sent.value.shape[1])
            cell = np.argmax(_near(_unit(x, measure), sent.value, "l2"), axis=1)
            keep = [i for i, n in enumerate(part.schema.names) if n != "v"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(cell.astype(np.int32))], names=[*(part.schema.names[i] for i in keep), "cell"])

    rows = vectors.select(*vectors.columns, owner.alias("owner"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{index.schema}, owner string, cell int")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def topk(index: VectorIndex, queries: DataFrame, k: int = 10, tenant: str | None = None, live: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The ``k`` nearest found chunks of each of ``queries(query_id, embedding)``: query_id, chunk_id, score, rank.

    ``live`` is a condition on the vectors' columns; ``tenant`` as in
    ``inverted.topk``. Questions whose vector the index could not hold find
    nothing.
    """
    if tenant and index.tenant != tenant:
        raise ValueError(f"the index is divided by {index.tenant}, not by {tenant}")
    dims, spark = index.centres.shape[1], index.spark
    asked = queries.where(usable(queries, dims))
    asked = asked.where(has_text(F.col(tenant))) if tenant else asked
    owner = F.col(tenant).cast("string") if tenant else F.lit(None).cast("string")
    asked = asked.select("query_id", F.col("embedding").cast("array<double>").alias("v"), owner.alias("owner"))
    held = index.vectors() if live is None else index.vectors().where(live)
    held = held.select("chunk_id", F.col("embedding").cast("array<double>").alias("v"), "owner", "cell")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {held.schema['chunk_id'].dataType.simpleString()}, score double"
    rows = asked.limit(QUESTIONS + 1).collect()
    found = _sent(index, rows, held, k, threshold, bool(tenant), kinds) if len(rows) <= QUESTIONS else _dealt(index, asked, held, k, threshold, bool(tenant), kinds)
    return ranked(found, k)


def _hits(ids, q, owners, chunks, x, theirs, k, threshold, owned, measure) -> Iterator[pd.DataFrame]:
    """Hits of questions among the vectors of a cell, by blocks of scores."""
    q, x = _unit(q, measure), _unit(x, measure)
    step = max(1, SCORES // max(1, len(x)))
    for at in range(0, len(ids), step):
        s = _scores(q[at : at + step], x, measure)
        if owned:
            s = np.where(owners[at : at + step, None] == theirs[None, :], s, -np.inf)
        i, j = np.nonzero((s > -np.inf) & (s >= (-np.inf if threshold is None else threshold)) & (s >= edge(s, k)[:, None]))
        if len(i):
            yield pd.DataFrame({"query_id": ids[at : at + step][i], "chunk_id": chunks[j], "score": s[i, j]})


def _sent(index: VectorIndex, rows: list, held: DataFrame, k: int, threshold: float | None, owned: bool, kinds: str) -> DataFrame:
    if not rows:
        return index.spark.range(0, 0, 1, 1).selectExpr(*[f"cast(null as {kind}) as {name}" for name, kind in (x.split(" ") for x in kinds.split(", "))])
    dims, measure = index.centres.shape[1], index.measure
    ids, q = np.array([r["query_id"] for r in rows]), np.array([r["v"] for r in rows], float)
    opened = index.opened(q)
    sent = index.spark.sparkContext.broadcast((ids, q, np.array([r["owner"] for r in rows], object), opened))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, owners, opened = sent.value
        best: pd.DataFrame | None = None
        for part in parts:
            cell, x = part.column("cell").to_numpy(), _matrix(part.column("v"), dims)
            chunks, theirs = part.column("chunk_id").to_numpy(zero_copy_only=False), part.column("owner").to_numpy(zero_copy_only=False)
            for c in np.unique(cell):
                here, mine = cell == c, (opened == c).any(axis=1)
                if mine.any():
                    for some in _hits(ids[mine], q[mine], owners[mine], chunks[here], x[here], theirs[here], k, threshold, owned, measure):
                        best = best_of(best, some, k)
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return held.where(F.col("cell").isin(np.unique(opened).tolist())).mapInArrow(search, kinds)


def _dealt(index: VectorIndex, asked: DataFrame, held: DataFrame, k: int, threshold: float | None, owned: bool, kinds: str) -> DataFrame:
    """The same for any number of questions: each goes to the parts of the cells that it opens, before the vectors there."""
    dims, measure = index.centres.shape[1], index.measure
    centres, probes = index.spark.sparkContext.broadcast(index.centres), index.probes
    kind = asked.schema["query_id"].dataType.simpleString()

    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = _near(_unit(_matrix(part.column("v"), dims), measure), centres.value, measure)
            opened = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(opened.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "cells"])

    dealt = asked.mapInArrow(cells, f"query_id {kind}, v array<double>, owner string, cells array<int>")
    dealt = dealt.select("query_id", "v", "owner", F.explode("cells").alias("cell"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int").alias("salt")
    both = dealt.select("cell", "salt", F.lit(0).alias("part"), "query_id", none(held, "chunk_id"), "v", "owner").unionByName(
        held.select("cell", salt, F.lit(1).alias("part"), none(asked, "query_id"), "chunk_id", "v", "owner"))

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_q, best = None, [], None
        for part in parts:
            key = part.column("cell").to_numpy() * SALTS + part.column("salt").to_numpy()
            side, x = part.column("part").to_numpy(), _matrix(part.column("v"), dims)
            ids, chunks = np.array(part.column("query_id").to_pylist(), object), np.array(part.column("chunk_id").to_pylist(), object)
            owners = part.column("owner").to_numpy(zero_copy_only=False)
            for one in dict.fromkeys(key.tolist()):
                if one != now:
                    now, held_q = one, []
                asks, has = (key == one) & (side == 0), (key == one) & (side == 1)
                if asks.any():
                    held_q.append((ids[asks], x[asks], owners[asks]))
                if has.any() and held_q:
                    q = [np.concatenate(c) for c in zip(*held_q)]
                    for some in _hits(q[0], q[1], q[2], chunks[has], x[has], owners[has], k, threshold, owned, measure):
                        best = best_of(best, some.infer_objects(), k)
                if best is not None and len(best) > SCORES // 8:
                    yield pa.RecordBatch.from_pandas(best, preserve_index=False)
                    best = None
        if best is not None:
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "part").mapInArrow(search, kinds)
