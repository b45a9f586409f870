"""Requests through the whole chain: guards, memory, retrieval, model, output guard, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import advisors, evaluate, retrieve
from ..sources.scratch import stored
from ..sources.tables import table
from . import events, retrieval
from .registry import query

FORBIDDEN = ("ndthe", "hathe")


def stand_in(rows: DataFrame) -> DataFrame:
    """In place of a model: the beginning of the first evidence, after the number of turns that it was told."""
    return rows.select("event_id", F.concat(F.size("history").cast("string"), F.lit(" turns: "), F.substring("first", 1, 200)).alias("answer"))


def chain_of(spark, sf_dir) -> list[advisors.Step]:
    messages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")
    search = lambda asked: retrieve.bm25_topk(retrieval.index(spark, sf_dir), asked)
    return [
        advisors.retrieval(search, retrieval.chunks(spark, sf_dir)), advisors.memory(messages, 3), advisors.output_guard(FORBIDDEN), advisors.audit(),
        advisors.guards(800, 1, 3600, ("et ",)),
    ]


def answered(spark, sf_dir) -> DataFrame:
    rows = events.requests(spark, sf_dir).withColumn("question", F.xxhash64("text")).withColumn("session", F.col("event_id") % 60)
    return advisors.answer(stored(rows), chain_of(spark, sf_dir), stand_in)


CHAIN = events.ADMITTED + ", d as (" + events.DECIDED + "), " + retrieval.BM.strip() + """,
hi as (select conv_id as session, least(count(*), 3) as turns from conversations group by 1),
bi as (select item_id, row_number() over (order by item_id) - 1 as item from benchmark),
ev as (select bi.item, count(*) as n_evidence, max(case when bm.rank = 1 then substr(x.text, 1, 200) end) as first from bm join bi on bi.item_id = bm.query_id join documents x on x.doc_id = bm.chunk_id where bm.rank <= 5 group by 1),
an as (select asked.event_id, coalesce(d.error_code, case when asked.stopped then 'PROMPT_INJECTION' end) as code, coalesce(turns, 0) || ' turns: ' || ev.first as said, n_evidence
  from asked join d using (event_id) left join ev using (item) left join hi on hi.session = asked.event_id % 60),
au as (select *, said is not null and (contains(said, 'ndthe') or contains(said, 'hathe')) as hit from an)"""


@query("answered_requests", CHAIN + """ select event_id, case when code is not null then 'REJECTED' when said is null then 'ERROR' else 'SUCCESS' end as status,
  case when code in ('RATE_LIMITED', 'TOKEN_BUDGET_EXCEEDED') then 429 when code is not null then 400 when said is null then 500 else 200 end as http_status,
  case when code is not null then code when said is null then 'NoAnswer' end as error_code, code is null and hit as blocked,
  case when code is null then sha256(case when hit then 'This answer was withheld.' else said end) end as answer from au""")
def answered_requests(spark, sf_dir):
    """One audit row for each request, whatever became of it."""
    return answered(spark, sf_dir).select("event_id", "status", F.col("http_status").cast("long").alias("http_status"), "error_code", "blocked", F.sha2("final_answer", 256).alias("answer"))


@query("judged_kinds", CHAIN + """, jd as (select event_id, unnest(case when event_id % 5 = 4 then ['rejection'] else ['faithfulness', 'relevancy'] end) as kind from au where code is null and said is not null) select kind, count(*) as prompts from jd group by kind""")
def judged_kinds(spark, sf_dir):
    """How many prompts of each kind a judge gets for the answers."""
    cases = answered(spark, sf_dir).select(F.col("event_id").alias("query_id"), (F.col("event_id") % 5 == 4).alias("negative"), F.col("text").alias("query"), F.col("first").alias("context"), F.col("final_answer").alias("answer"))
    return evaluate.judge_prompts(cases).groupBy("kind").agg(F.count("prompt").alias("prompts"))
