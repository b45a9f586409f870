"""Search for whole sets of questions: BM25 over the text index, exact search over vectors.

Up to ``QUESTIONS`` vectors of questions are one block, which is broadcast; each
task keeps its own best hits of every question, so that only those are
shuffled. More are laid out in blocks against blocks of the corpus, with the
same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text
from ..sources.scratch import exists, kept_path, stored
from . import inverted
from .inverted import TextIndex
from .rank import BROADCAST_ROWS, best_of, edge, ranked, small  # noqa: F401

QUESTIONS = 20_000
#: Rows of a block of the corpus, and cells of a block of scores.
BLOCK, CELLS = 4_096, 1 << 21


def index_chunks(chunks: DataFrame, text: str = "text", path: str | None = None) -> TextIndex:
    """``chunks(chunk_id, text, ...)`` to a text index, divided by ``tenant`` if there is such a column."""
    return inverted.build(chunks, path, text, "tenant" if "tenant" in chunks.columns else None)


def kept_index(chunks: DataFrame, text: str = "text") -> TextIndex:
    """As ``index_chunks``, once for the files that ``chunks`` are read from: later calls open what is there."""
    spark, path = chunks.sparkSession, kept_path(chunks, f"index-{inverted.FORMAT}-{'-'.join(chunks.columns)}")
    if exists(spark, f"{path}/manifest/version=1/_SUCCESS"):
        index = inverted.open_index(spark, path, 1)
        if all(exists(spark, f"{path}/{part}/segment={s}/_SUCCESS") for part in ("chunks", "postings", "dfs", "dead") for s in index.segments):
            return index
        path = None  # somebody has cleared away parts of it
    return index_chunks(chunks, text, path)


def bm25_topk(index: TextIndex, queries: DataFrame, k: int = 10, tenant: str | None = None, live: Column | None = None) -> DataFrame:
    """See ``inverted.topk``."""
    return inverted.topk(index, queries, k, tenant, live)


def _same_tenant(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    return mine[:, None] == theirs[None, :]


def _scores(q: np.ndarray, x: np.ndarray, measure: str) -> np.ndarray:
    """Questions by rows; what has no measure (zero vectors under cosine) is minus infinity."""
    s = q @ x.T
    if measure == "l2":
        s = -np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * s))
    elif measure == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            s = s / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    return np.where(np.isfinite(s), s, -np.inf)


def _vector_hits(queries: DataFrame, corpus: DataFrame, k: int | None, measure: str, threshold: float | None, tenant: str | None) -> DataFrame:
    """``(query_id, chunk_id, score)``: each task's ``k`` best of each question, or all at or over the threshold."""
    spark, own = queries.sparkSession, F.col(tenant) if tenant else F.lit(None).cast("string")
    asked = (known_tenants(queries, tenant) if tenant else queries).select("query_id", "embedding", own.alias("tenant")).where("embedding is not null")
    held = corpus.select("chunk_id", "embedding", own.alias("tenant")).where("embedding is not null")
    least = -np.inf if threshold is None else threshold
    kinds = [f"{c} {d.schema[c].dataType.simpleString()}" for c, d in (("query_id", queries), ("chunk_id", corpus))]
    schema = f"{', '.join(kinds)}, score double"

    def block(ids, q, tenants, chunks, x, theirs) -> Iterator[pd.DataFrame]:
        step = max(1, CELLS // max(1, len(x)))
        for at in range(0, len(ids), step):
            s = _scores(q[at : at + step], x, measure)
            if tenant:
                s = np.where(_same_tenant(tenants[at : at + step], theirs), s, -np.inf)
            i, j = np.nonzero((s > -np.inf) & (s >= least) & (True if k is None else s >= edge(s, k)[:, None]))
            yield pd.DataFrame({"query_id": ids[at : at + step][i], "chunk_id": chunks[j], "score": s[i, j]})

    def matrix(v) -> np.ndarray:
        return np.stack(list(v)).astype(float)

    if asked.limit(QUESTIONS + 1).count() <= QUESTIONS:
        rows = asked.collect()
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float).reshape(len(rows), -1), np.array([r[2] for r in rows], object)))

        def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: pd.DataFrame | None = None
            for pdf in parts:
                if not len(pdf) or not len(sent.value[0]):
                    continue
                for some in block(*sent.value, pdf["chunk_id"].to_numpy(), matrix(pdf["embedding"]), pdf["tenant"].to_numpy()):
                    if k is None:
                        yield some
                    else:
                        best = best_of(best, some, k)
            if best is not None:
                yield best

        return held.mapInPandas(search, schema)

    def blocks(df: DataFrame, id_col: str, size: int, name: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "embedding", "tenant")).alias(name))

    # questions in blocks against the corpus in blocks, each pair of blocks once
    pairs = stored(blocks(asked, "query_id", BLOCK, "q")).crossJoin(stored(blocks(held, "chunk_id", BLOCK, "c"))).repartition("q_block", "c_block")

    def search_pairs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for q, c in zip(pdf["q"], pdf["c"]):
                side = lambda rows: (np.array([r["id"] for r in rows]), matrix(r["embedding"] for r in rows), np.array([r["tenant"] for r in rows], object))
                yield from block(*side(q), *side(c))

    return pairs.select("q", "c").mapInPandas(search_pairs, schema)


def similarity(queries: DataFrame, corpus: DataFrame, measure: str = "cosine", threshold: float = 0.5) -> DataFrame:
    """``(query_id, chunk_id, score)`` of all pairs at or over the threshold."""
    return _vector_hits(queries, corpus, None, measure, threshold, None)


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, measure: str = "cosine", threshold: float | None = None, tenant: str | None = None, live: Column | None = None) -> DataFrame:
    """The ``k`` nearest chunks of each question: query_id, chunk_id, score, rank.

    ``live`` and ``tenant`` (see ``bm25_topk``) are applied before the search.
    """
    held = corpus if live is None else corpus.where(live)
    return ranked(_vector_hits(queries, held, k, measure, threshold, tenant), k)


def known_tenants(queries: DataFrame, tenant: str = "tenant") -> DataFrame:
    """Questions of a tenant that is neither null nor white space; the others are not searched for at all."""
    return queries.where(has_text(F.col(tenant)))
