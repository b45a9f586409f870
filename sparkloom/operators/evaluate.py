"""Retrieval metrics, report and gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chain

GATES = {"recall": 0.85, "mrr": 0.70, "faithfulness": 4.0, "rejection": 0.85}


def metrics(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``cases(query_id, expected array)`` and ``hits(query_id, chunk_id, rank)`` to recall, reciprocal rank and context precision.

    Null where nothing is expected. Retrieved ids count once, at their best rank.
    """
    once = hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    want = cases.select("query_id", F.explode(F.array_distinct("expected")).alias("chunk_id"), F.lit(1).alias("rel"))
    w = Window.partitionBy("query_id").orderBy("rank")
    marked = once.join(want, ["query_id", "chunk_id"], "left").select("query_id", "rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    run = marked.withColumn("seen", F.sum("rel").over(w)).withColumn("place", F.row_number().over(w))
    per = run.groupBy("query_id").agg(
        F.sum("rel").alias("found"), F.min(F.when(F.col("rel") == 1, F.col("place"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("place"))).alias("precision"),
    )
    n = F.size("expected")
    has = n > 0
    return cases.join(per, "query_id", "left").select(
        "query_id",
        F.when(has, F.coalesce("found", F.lit(0)) / n).alias("recall"),
        F.when(has, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(has, F.coalesce("precision", F.lit(0.0)) / n).alias("context_precision"),
    )


def report(metrics: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of counts and averages. ``metrics`` is what ``metrics`` gives, ``judged(query_id, negative, faithfulness, relevancy, verdict)`` the judge's scores; what is null does not count.

    Faithfulness and relevancy are of questions that have an answer and were
    judged for faithfulness, rejection (the share of verdicts REJECTED, in any
    case) of those that have none and a verdict.
    """
    refused = F.when(F.upper("verdict") == "REJECTED", 1.0).otherwise(0.0)
    said, turned = ~F.col("negative") & F.col("faithfulness").isNotNull(), F.col("negative") & F.col("verdict").isNotNull()
    return metrics.join(judged, "query_id").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count("recall").alias("n_retrieval"), F.count_if(said).alias("n_generation"), F.count_if(turned).alias("n_negative"),
        F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("context_precision"), 6).alias("context_precision"),
        F.round(F.avg(F.when(said, F.col("faithfulness"))), 6).alias("faithfulness"), F.round(F.avg(F.when(said, F.col("relevancy"))), 6).alias("relevancy"),
        F.round(F.avg(F.when(turned, refused)), 6).alias("rejection"),
    )


#: What a judge is asked, by what it judges; the fields are filled by ``chain.filled``.
JUDGES = {
    "faithfulness": "Judge whether the answer says only what the evidence says. Check each statement of fact against the evidence first, as the reason; then give a score from 1 (made up, or against the evidence) to 5 (nothing without evidence).\n\nQuestion:\n{query}\n\nEvidence:\n{context}\n\nAnswer:\n{answer}",
    "relevancy": "Judge how fully and directly the answer meets the question, not whether it is true. Say what is missing or beside the point first, as the reason; then give a score from 1 (does not meet it) to 5 (meets all of it and nothing else).\n\nQuestion:\n{query}\n\nAnswer:\n{answer}",
    "rejection": "The knowledge base holds nothing about this question. Judge whether the answer says so and stops. Give the reason first; then the verdict REJECTED (score 5), PARTIAL (doubts, but answers in part; score 3) or NOT_REJECTED (answers as if it knew; score 1).\n\nQuestion:\n{query}\n\nAnswer:\n{answer}",
}


def judge_prompts(cases: DataFrame) -> DataFrame:
    """``cases(query_id, negative, query, context, answer)`` to ``(query_id, kind, prompt)``: what each is judged for; a case without an answer is not judged."""
    said = cases.where("answer is not null")
    fields = {c: F.coalesce(c, F.lit("")) for c in ("query", "context", "answer")}
    kinds = F.when(F.col("negative"), F.array(F.lit("rejection"))).otherwise(F.array(F.lit("faithfulness"), F.lit("relevancy")))
    prompt = F.lit(None).cast("string")
    for kind, template in JUDGES.items():
        prompt = F.when(F.col("kind") == kind, chain.filled(template, **fields)).otherwise(prompt)
    return said.withColumn("kind", F.explode(kinds)).select("query_id", "kind", prompt.alias("prompt"))


def compared(cases: DataFrame, probes: dict[str, tuple[int, Callable[[], DataFrame]]]) -> DataFrame:
    """The averages of each probe (name: order, hits) over the same cases; the probe of the least order is ``chosen``."""
    first, out = min(order for order, _ in probes.values()), None
    for name, (order, hits) in probes.items():
        row = metrics(cases, hits()).agg(
            F.lit(name).alias("probe"), F.lit(order == first).alias("chosen"), F.count(F.lit(1)).alias("n_cases"),
            F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("context_precision"), 6).alias("context_precision"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def gate(report: DataFrame) -> DataFrame:
    """A row per gated metric of a one-row report that has a value."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).cast("double").alias("threshold")) for m, t in GATES.items()])
    return report.select(F.explode(pairs).alias("g")).select("g.*").where("value is not null").withColumn("passed", F.col("value") >= F.col("threshold"))
