"""Reciprocal-rank fusion, truncation and the merged view of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def fuse(vector: DataFrame, bm25: DataFrame, limit: int = 10, k: int = RRF_K) -> DataFrame:
    """Hits ``(query_id, chunk_id, score, rank, ...)`` of both paths to one list.

    One union and one aggregation. Ties keep the vector path's order, then
    that of chunks only the other path has. Other columns are metadata, of
    which either path may lack some; the vector path's values win.
    """
    key = ["query_id", "chunk_id", "path", "rank", "score"]
    both = vector.withColumn("path", F.lit("v")).unionByName(bm25.withColumn("path", F.lit("b")), allowMissingColumns=True)
    carried = [c for c in both.columns if c not in key]
    of = lambda p, c: F.max(F.when(F.col("path") == p, F.col(c)))
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("fusion_score"), of("v", "rank").alias("vector_rank"), of("b", "rank").alias("bm25_rank"),
        of("v", "score").alias("vector_score"), of("b", "score").alias("bm25_score"), *[F.coalesce(of("v", c), of("b", c)).alias(c) for c in carried],
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("fusion_score", 12)), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
    return fused.withColumn("fused_rank", F.row_number().over(w)).where(F.col("fused_rank") <= limit)


def rerank_degraded(hits: DataFrame, k: int = 5) -> DataFrame:
    """Without a rerank model: fusion score, else own score, else 0; the best ``k``, earlier ones first on ties."""
    order = F.coalesce("fusion_score", "score", F.lit(0.0)) if "score" in hits.columns else F.coalesce("fusion_score", F.lit(0.0))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(order, 12)), F.asc_nulls_last("fused_rank"))
    return hits.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


def apply_rerank(hits: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """``results(query_id, index, relevance)`` of a model, by zero-based place; places out of range are dropped."""
    placed = hits.withColumn("index", F.col("fused_rank") - 1)
    joined = placed.join(results, ["query_id", "index"])
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "index")
    return joined.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)


RESULTS = "array<struct<index:int,relevance_score:double>>"


def rerank_results(responses: DataFrame, body: str = "body") -> DataFrame:
    """A rerank service's answers ``(query_id, body)``, JSON of either shape, to ``(query_id, index, relevance)``.

    The list stands in ``results`` or in ``output.results``. Answers that are
    no JSON, or hold no list, give no rows, and their questions are to be
    truncated by ``rerank_degraded``.
    """
    j = F.from_json(F.col(body), f"results {RESULTS}, output struct<results:{RESULTS}>")
    return responses.select("query_id", F.explode(F.coalesce(j["results"], j["output"]["results"])).alias("r")).select("query_id", F.col("r.index").alias("index"), F.col("r.relevance_score").alias("relevance"))


def rerank(hits: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """``apply_rerank`` where the service answered, ``rerank_degraded`` for the other questions."""
    answered = results.select("query_id").distinct()
    scored = apply_rerank(hits, results, k)
    return scored.unionByName(rerank_degraded(hits.join(answered, "query_id", "left_anti"), k), allowMissingColumns=True)


def best_of_variants(hits: DataFrame, k: int) -> DataFrame:
    """Hits of several variants of a question to its ``k`` best, each chunk once with its best score."""
    once = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "chunk_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def debug_candidates(vector: DataFrame, bm25: DataFrame, final: DataFrame) -> DataFrame:
    """Every candidate of a question with all its scores and ranks; the final ones first, then the rest in path order."""
    rows = (
        bm25.select("query_id", "chunk_id", F.lit("b").alias("p"), "rank", "score")
        .unionByName(vector.select("query_id", "chunk_id", F.lit("v").alias("p"), "rank", "score"))
        .unionByName(final.select("query_id", "chunk_id", F.lit("f").alias("p"), F.col("final_rank").alias("rank"), F.col("fusion_score").alias("score")))
    )
    of = lambda p, c: F.max(F.when(F.col("p") == p, F.col(c)))
    out = rows.groupBy("query_id", "chunk_id").agg(
        of("b", "rank").alias("bm25_rank"), of("b", "score").alias("bm25_score"), of("v", "rank").alias("vector_rank"), of("v", "score").alias("vector_score"),
        of("f", "rank").alias("final_rank"), of("f", "score").alias("fusion_score"),
    )
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("final_rank"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"))
    return out.withColumn("position", F.row_number().over(w))
