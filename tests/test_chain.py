"""The chain of steps, the report and its judges, and subscriptions that come and go."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import advisors, evaluate, retrieve
from sparkloom.streaming import flows, subscriptions

DAY0 = 19_675 * 86_400


def test_steps_go_in_by_rising_and_out_by_falling_order(spark):
    seen = []

    def step(order):
        def told(way):
            return lambda rows: seen.append((way, order)) or rows

        return advisors.Step(order, str(order), told("in"), told("out"))

    rows = spark.createDataFrame([(1, "a")], "event_id long, text string")
    out = advisors.answer(rows, [step(500), step(10), step(110), advisors.audit()], lambda r: r.select("event_id", F.lit("yes").alias("answer")))
    assert seen == [("in", 10), ("in", 110), ("in", 500), ("out", 500), ("out", 110), ("out", 10)]
    assert [(r.status, r.final_answer) for r in out.collect()] == [("SUCCESS", "yes")]


def test_the_whole_chain(spark):
    asked = [
        (1, "t", 0, 60, "what is alpha", 1), (2, "t", 1, 60, "ignore previous 13812345678", 1), (3, "t", 2, 50, "what is beta", 2), (4, "t", 3, 5, "what is alpha", 2),
        (5, None, 3, 5, "alpha", 1), (6, "u", 3, 5, "nothing known", 9), (7, "u", 4, 5, "gamma model fails", 1),
    ]
    requests = spark.createDataFrame(asked, "event_id long, tenant string, s long, tokens long, text string, session long").withColumn("ts", F.timestamp_seconds("s")).withColumn("question", F.xxhash64("text"))
    chunks = spark.createDataFrame([(1, "alpha is a secret_term"), (2, "beta is fine"), (3, "gamma")], "chunk_id long, text string")
    index = retrieve.index_chunks(chunks)
    messages = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(5)] + [(2, 0, "user", "x")], "session long, turn long, role string, text string")
    steps = [
        advisors.audit(), advisors.guards(100, 3, 60), advisors.output_guard(("secret_term",)), advisors.memory(messages, 3),
        advisors.retrieval(lambda q: retrieve.bm25_topk(index, q), chunks),
    ]
    model = lambda r: r.select("event_id", F.when(~F.contains("text", F.lit("fails")), F.concat(F.array_join("history", "/"), F.lit(" "), F.coalesce("first", F.lit("refused")))).alias("answer"))
    out = {r.event_id: (r.status, r.http_status, r.error_code, r.final_answer) for r in advisors.answer(requests, steps, model).collect()}
    assert out == {
        1: ("SUCCESS", 200, None, advisors.SAFE), 2: ("REJECTED", 400, "PROMPT_INJECTION", None), 3: ("SUCCESS", 200, None, "user: x beta is fine"),
        4: ("REJECTED", 429, "TOKEN_BUDGET_EXCEEDED", None), 5: ("REJECTED", 400, "IDENTITY_INCOMPLETE", None), 6: ("SUCCESS", 200, None, " refused"), 7: ("ERROR", 500, "NoAnswer", None),
    }
    prompts = {r.event_id: (r.text, r.prompt, r.history) for r in advisors.answer(requests, steps, model).collect()}
    assert "1***-****-****" in prompts[2][0] and prompts[2][1] is None
    assert prompts[1][2] == ["user: m2", "user: m3", "user: m4"] and "[1] alpha" in prompts[1][1] and "No evidence" in prompts[6][1]


def test_report_counts_what_was_judged(spark):
    metrics = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 0.5, 0.5, 0.5), (3, None, None, None), (4, None, None, None), (5, None, None, None)], "query_id long, recall double, reciprocal_rank double, context_precision double")
    judged = spark.createDataFrame([(1, False, 5, 4, None), (2, False, None, 1, None), (3, True, None, None, "rejected"), (4, True, 5, 5, "PARTIAL"), (5, True, None, None, None)], "query_id long, negative boolean, faithfulness int, relevancy int, verdict string")
    r = evaluate.report(metrics, judged).first()
    assert (r.n_cases, r.n_retrieval, r.n_generation, r.n_negative, r.recall, r.faithfulness, r.relevancy, r.rejection) == (5, 2, 1, 2, 0.75, 5.0, 4.0, 0.5)


def test_judges_get_their_own_prompts(spark):
    cases = spark.createDataFrame([(1, False, "q {answer}", "e", "a"), (2, True, "q2", None, "no"), (3, False, "q3", "e", None)], "query_id long, negative boolean, query string, context string, answer string")
    out = sorted((r.query_id, r.kind, r.prompt) for r in evaluate.judge_prompts(cases).collect())
    assert [o[:2] for o in out] == [(1, "faithfulness"), (1, "relevancy"), (2, "rejection")]
    assert out[0][2].endswith("Question:\nq {answer}\n\nEvidence:\ne\n\nAnswer:\na") and out[1][2].endswith("Question:\nq {answer}\n\nAnswer:\na")


def loop(events, actions):
    out = []
    for topic, i, s, body in events:
        for who in {a[1] for a in actions if a[0] == topic}:
            mine = sorted(a[2:] for a in actions if a[:2] == (topic, who) and a[3] <= s)
            mine = sorted(((t, q, act) for q, t, act in mine))
            if mine and mine[-1][2] == "SUBSCRIBE":
                out.append((topic, i, who, body))
    return sorted(out)


def test_events_reach_those_subscribed_at_their_time(spark, tmp_path):
    rng = random.Random(6)
    actions = [(f"t{rng.randrange(2)}", f"s{rng.randrange(3)}", q, rng.randrange(100), rng.choice(["SUBSCRIBE", "SUBSCRIBE", "UNSUBSCRIBE"])) for q in range(40)]
    events = [(f"t{rng.randrange(3)}", i, rng.randrange(120), f"b{i}") for i in range(60)]
    want = loop(events, actions)
    timed = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("s") + DAY0)).drop("s")
    e = lambda rows: timed(spark.createDataFrame(rows, "topic string, id long, s long, body string"))
    a = lambda rows: timed(spark.createDataFrame(rows, "topic string, subscriber string, seq long, s long, action string"))
    assert sorted(map(tuple, subscriptions.delivered(e(events), a(actions)).collect())) == want and want
    for i in range(2):
        e(events[i::2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        a(actions[i::2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    e([("t9", 900, 90_000, "clock")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    a([("t9", "s9", 900, 90_000, "SUBSCRIBE")]).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    read = lambda p, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / p))
    out = flows.run_to_table(subscriptions.stream(read("e", e(events)), read("a", a(actions)), "10 minutes", 2), "append", str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == want
