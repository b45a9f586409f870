"""Answering questions as one chain of transforms: guards, rewriting, prompts and the audit of it all.

The order of the chain is that of the guards: budget, rate, injection; the first
that rejects a request names its error. What a model does (rewriting, judging,
answering) is a function on DataFrames that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import metering

GROUNDED = "Answer from the evidence only and cite it as [ref-N].\n\nEvidence:\n{context}\n\nQuestion:\n{query}"
REFUSAL = "No evidence was found for this question. Say so and nothing else."
#: Errors of quotas, which a service answers with status 429.
QUOTAS = ("RATE_LIMITED", "TOKEN_BUDGET_EXCEEDED")


def guarded(requests: DataFrame, budget: float, limit: int, seconds: int = 60, terms: tuple[str, ...] = T.INJECTION) -> DataFrame:
    """``requests(event_id, tenant, ts, tokens, text)`` with ``error_code`` (null: let through) and the masked text ``sanitized``.

    Budget, rate and the text are looked at in that order. A request that is
    turned away uses no quota, but for one that only its text stops: that has
    its permit, and books no tokens. A null or blank tenant has no quota and
    is rejected. ``event_id`` tells requests apart.
    """
    judged = requests.withColumn("stopped", T.has_any(F.col("text"), list(terms), True))
    codes = metering.admitted(judged, budget, limit, seconds).select("event_id", F.col("error_code").alias("quota_code"))
    code = F.coalesce("quota_code", F.when(F.col("stopped"), F.lit("PROMPT_INJECTION")))
    return judged.join(codes, "event_id").select(*requests.columns, code.alias("error_code"), T.sanitize(F.col("text")).alias("sanitized"))


def rewritten(queries: DataFrame, rewrite: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``queries(query_id, text)`` with ``rewritten_query``, which retrieval uses and the audit keeps; without a model it is the text."""
    return queries.withColumn("rewritten_query", F.col("text")) if rewrite is None else rewrite(queries)


def expanded(queries: DataFrame, variants: Callable[[Column], list[Column]]) -> DataFrame:
    """A row for each variant of a question: query_id, variant, text."""
    return queries.select("query_id", F.posexplode(F.array(*variants(F.col("text")))).alias("variant", "text"))


def filled(template: str, **values: Column) -> Column:
    """A template with its ``{name}`` places filled; braces in the values stay as they are."""
    out, rest = F.lit(""), template
    while rest:
        at, name = min(((rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest), default=(-1, ""))
        if at < 0:
            return F.concat(out, F.lit(rest))
        out, rest = F.concat(out, F.lit(rest[:at]), values[name]), rest[at + len(name) + 2 :]
    return out


def prompts(queries: DataFrame, finals: DataFrame, most: int | None = None, template: str = GROUNDED, refusal: str = REFUSAL) -> DataFrame:
    """``finals(query_id, chunk_id, final_rank, content)`` to a prompt for each question; without evidence it is the refusal."""
    content = F.col("content") if most is None else T.truncate(F.col("content"), most)
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), content)
    context = finals.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("context"))
    made = F.when(F.col("context").isNull(), F.lit(refusal)).otherwise(filled(template, query=F.col("text"), context=F.col("context")))
    return queries.join(context, "query_id", "left").select("query_id", made.alias("prompt"))


def status(error_class: Column, error_code: Column) -> Column:
    """SUCCESS without an error, REJECTED for one with a code, else ERROR."""
    return F.when(error_class.isNull(), F.lit("SUCCESS")).when(error_code.isNotNull(), F.lit("REJECTED")).otherwise(F.lit("ERROR"))


def http_status(error_class: Column, error_code: Column) -> Column:
    return F.when(error_class.isNull(), F.lit(200)).when(error_code.isin(*QUOTAS), F.lit(429)).when(error_code.isNotNull(), F.lit(400)).otherwise(F.lit(500))


def usage_json(prompt: Column, completion: Column, total: Column) -> Column:
    """Null where the total is."""
    return F.when(total.isNotNull(), F.to_json(F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), total.alias("total_tokens"))))


def _listed(hits: DataFrame, score: str, order: list[str], name: str) -> DataFrame:
    item = F.struct(F.col("chunk_id").cast("string").alias("chunk_id"), "file_name", F.round(score, 6).alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct(*order, item.alias("item"))))
    return hits.groupBy("query_id").agg(F.to_json(F.transform(ordered, lambda x: x["item"])).alias(name))


def audited(requests: DataFrame, raw: DataFrame, final: DataFrame) -> DataFrame:
    """One audit row per request.

    ``requests`` has query_id, text, rewritten_query, error_class, error_code,
    prompt_tokens, completion_tokens, total_tokens and latency_ms; ``raw`` the
    hits of both paths (path, rank, chunk_id, file_name, fusion_score) and
    ``final`` those that were used (final_rank, chunk_id, file_name,
    rerank_score). Scores that are null are left out of the lists.
    """
    lists = _listed(raw, "fusion_score", ["path", "rank"], "retrieved_chunks").join(_listed(final, "rerank_score", ["final_rank"], "reranked_chunks"), "query_id", "full")
    failed = F.col("error_class"), F.col("error_code")
    found = F.col("retrieved_chunks").isNotNull() | F.col("reranked_chunks").isNotNull()
    return requests.join(lists, "query_id", "left").select(
        "query_id", F.coalesce("text", F.lit("")).alias("query_text"), "rewritten_query", F.when(found, F.lit("hybrid")).alias("retrieval_type"),
        "retrieved_chunks", "reranked_chunks", F.least(F.col("latency_ms").cast("long"), F.lit(2**31 - 1)).alias("latency_ms"),
        usage_json(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("total_tokens")).alias("token_usage"),
        status(*failed).alias("status"), F.when(F.col("error_class").isNotNull(), F.coalesce("error_code", "error_class")).alias("error_code"),
    )
