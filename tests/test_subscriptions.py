"""Fan-out and subscriptions that come and go, against plain loops; no step makes all pairs."""

import random

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.operators import catalog
from sparkloom.streaming import subscriptions


def test_fanout_is_counted_without_pairs(spark):
    n = 20_000
    told = spark.range(n).select(F.lit("t").alias("topic"), F.col("id").alias("event_id"))
    held = spark.range(n).select(F.col("id").alias("session"), F.lit("t").alias("topic"))  # 400 million pairs
    out = catalog.fanout_counts(told, held)
    assert out.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.max("first_id")).first() == (n, n, n, 0)
    few = [(1, "a"), (1, "b"), (2, "b"), (3, None), (4, "c")]
    events, subs = spark.createDataFrame([("a", 5), ("a", 3), ("b", 9), (None, 1)], "topic string, event_id long"), spark.createDataFrame(few, "session long, topic string")
    want = catalog.fanned_out(events, subs).groupBy("session").agg(F.count(F.lit(1)), F.min("event_id"))
    assert sorted(map(tuple, catalog.fanout_counts(events, subs).collect())) == sorted(map(tuple, want.collect())) == [(1, 3, 3), (2, 1, 9)]


def test_spans_meet_events_by_blocks_of_places(spark, monkeypatch):
    monkeypatch.setattr(subscriptions, "BLOCK", 4)
    rng = random.Random(3)
    events = [("t", i, rng.randrange(50) if i % 9 else None, f"b{i}") for i in range(200)] + [(None, 900, 1, "b")]
    actions = [("t", f"s{rng.randrange(4)}" if q % 7 else None, q, rng.randrange(50), rng.choice(["SUBSCRIBE", "UNSUBSCRIBE"])) for q in range(60)] + [(None, "s1", 99, 0, "SUBSCRIBE")]
    timed = lambda rows, names: spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_seconds(F.col("s") * 1_000)).drop("s")
    out = subscriptions.delivered(timed(events, "topic string, id long, s long, body string"), timed(actions, "topic string, subscriber string, seq long, s long, action string"))
    want = []
    for topic, i, s, body in events:
        for who in {a[1] for a in actions if topic and s is not None}:
            last = max(((a[3], a[2], a[4]) for a in actions if a[:2] == (topic, who) and a[3] <= s), default=None)
            if last and last[2] == "SUBSCRIBE":
                want.append((topic, i, who or "", body))
    assert sorted((r[0], r[1], r[2] or "", r[3]) for r in out.collect()) == sorted(want) and want
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert joins and all("block" in x for x in joins if ">=" in x)


def test_stream_writes_few_entries_of_state(spark):
    """A batch's rows of a topic are one entry of what waits, not one each."""
    rows = pd.DataFrame({"us": range(25_000), "kind": 1, "seq": range(25_000), "given": True, "who": None, "action": None, "body": "b"})
    assert [len(pa.ipc.open_stream(x).read_all()) for (x,) in subscriptions._packed(pa.Table.from_pandas(rows, subscriptions.WAITING))] == [10_000, 10_000, 5_000]
