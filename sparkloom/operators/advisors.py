"""One chain from a request to its audited answer, as an ordered list of steps.

A step may act before the model, after it, or both; what acts before goes by
rising order, what acts after by falling order, so the outermost step (the
audit) sees whatever became of a request, also one that was turned away.
Steps are functions on whole tables. Requests carry ``error_code`` and
``error_class``; where one is set, later steps and the model leave a request alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.scratch import stored
from . import chain
from .rank import small

Table = Callable[[DataFrame], DataFrame]
#: What a guard's rejection is called in the audit, next to its code.
REJECTION = "BusinessError"
SAFE = "This answer was withheld."


@dataclass(frozen=True)
class Step:
    order: int
    name: str
    before: Table | None = None
    after: Table | None = None


def answer(requests: DataFrame, steps: list[Step], model: Table) -> DataFrame:
    """``requests(event_id, text, ...)`` through all steps and the model, which adds ``answer`` (null: it failed)."""
    none = F.lit(None).cast("string")
    rows = requests.withColumns({"error_code": none, "error_class": none})
    ordered = sorted(steps, key=lambda s: s.order)
    for step in ordered:
        rows = step.before(rows) if step.before else rows
    passed = F.col("error_class").isNull()
    said = model(rows.where(passed)).select("event_id", "answer")
    rows = rows.join(said, "event_id", "left")
    rows = rows.withColumn("error_class", F.when(passed & F.col("answer").isNull(), F.lit("NoAnswer")).otherwise(F.col("error_class")))
    for step in reversed(ordered):
        rows = step.after(rows) if step.after else rows
    return rows


def guards(budget: float, limit: int, seconds: int = 60, terms: tuple[str, ...] = T.INJECTION) -> Step:
    """Budget, rate and what a text must not say, in that order; they are one step, as a request's fate in one is felt in the others.

    What it decides is written once, as the steps after it look at it several times, and each look would be all tenants' folds anew.
    """

    def before(rows: DataFrame) -> DataFrame:
        judged = chain.guarded(rows.drop("error_code"), budget, limit, seconds, terms)
        return stored(judged.withColumn("error_class", F.when(F.col("error_code").isNotNull(), F.lit(REJECTION))).drop("text").withColumnRenamed("sanitized", "text"))

    return Step(30, "guards", before)


def output_guard(terms: tuple[str, ...], safe: str = SAFE) -> Step:
    """An answer that holds a forbidden term is replaced as a whole."""

    def after(rows: DataFrame) -> DataFrame:
        hit = T.has_any(F.col("answer"), list(terms), False)
        return rows.withColumns({"blocked": hit, "answer": F.when(hit, F.lit(safe)).otherwise(F.col("answer"))})

    return Step(110, "output guard", None, after)


def memory(messages: DataFrame, keep: int = 20) -> Step:
    """The last ``keep`` of ``messages(session, turn, role, text)`` of a request's session, as ``history``, oldest first."""

    def before(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn")))
        kept = messages.withColumn("place", place).where(F.col("place") <= keep)
        line = F.concat("role", F.lit(": "), "text")
        told = kept.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]).alias("history"))
        return rows.join(told, "session", "left").withColumn("history", F.coalesce("history", F.array().cast("array<string>")))

    return Step(400, "memory", before)


def retrieval(search: Table, contents: DataFrame, k: int = 5, key: str = "question") -> Step:
    """Evidence and prompt: ``search`` gives the hits of ``(query_id, text)``, each different question once, ``contents(chunk_id, text)`` their texts.

    The questions, and the texts that were found, are written once: every use would search and read the texts anew.
    A request that was turned away gets none, so its row stays small.
    """

    def before(rows: DataFrame) -> DataFrame:
        asked = stored(rows.where("error_class is null").groupBy(key).agg(F.min("text").alias("text")).withColumnRenamed(key, "query_id"))
        hits = stored(search(asked).where(F.col("rank") <= k).select("query_id", "chunk_id", F.col("rank").alias("final_rank")))
        finals = stored(contents.select("chunk_id", F.col("text").alias("content")).join(small(hits), "chunk_id"))
        evidence = finals.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_evidence"), F.min_by("content", "final_rank").alias("first"))
        made = chain.prompts(asked, finals).join(evidence, "query_id", "left")
        met = rows.join(made, F.col("error_class").isNull() & (F.col(key) == F.col("query_id")), "left").drop("query_id")
        return met.withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))

    return Step(500, "retrieval", before)


def audit() -> Step:
    """What is told of every request, whatever became of it."""

    def after(rows: DataFrame) -> DataFrame:
        failed = F.col("error_class"), F.col("error_code")
        return rows.withColumns({
            "status": chain.status(*failed), "http_status": chain.http_status(*failed),
            "error_code": F.when(failed[0].isNotNull(), F.coalesce(failed[1], failed[0])), "final_answer": F.when(failed[0].isNull(), F.col("answer")),
        })

    return Step(10, "audit", None, after)
