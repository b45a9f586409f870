"""Streams give what the batch forms give; state machines against plain loops."""

from pyspark.sql import functions as F

from sparkloom.operators import metering
from sparkloom.queries import events
from sparkloom.streaming import flows

SF = "/root/testdata/sf0.001"
ACTIONS = [
    ("a", 1, 0, "create", "u", True), ("a", 2, 10, "consume", "u", False), ("a", 3, 20, "approve", "x", False), ("a", 4, 30, "approve", "u", True), ("a", 5, 40, "consume", "u", True),
    ("a", 6, 50, "consume", "u", False), ("b", 1, 0, "create", "u", True), ("b", 2, 700, "approve", "u", False), ("c", 1, 0, "approve", "u", False), ("d", 1, 0, "create", "u", True), ("d", 2, 500, "approve", "u", True), ("d", 3, 1000, "consume", "u", True),
]


def table_of(rows):
    return sorted(map(tuple, rows.collect()))


def test_approvals(spark):
    df = spark.createDataFrame([(*a[:4], "t", a[4]) for a in ACTIONS], "approval_id string, seq long, s long, action string, tenant string, user string").withColumn("ts", F.timestamp_seconds("s"))
    assert table_of(metering.approvals(df).select("approval_id", "seq", "done")) == [(a[0], a[1], a[5]) for a in ACTIONS]


def test_circuit_breaker_against_plain_loop(spark):
    got = table_of(events.circuit_breaker(spark, SF))
    calls = {}
    for r in events.calls(spark, SF).collect():
        calls.setdefault(r.key, []).append((r.seq, r.ts.timestamp(), r.ok))
    want = []
    for key, rows in calls.items():
        is_open, trial, failures, since = False, False, 0, 0.0
        for seq, now, ok in sorted(rows):
            if is_open and now - since >= 3600:
                is_open, trial = False, True
            want.append((key, seq, "OPEN" if is_open else "HALF_OPEN" if trial else "CLOSED", not is_open))
            if is_open:
                continue
            failures = 0 if ok else failures + 1
            if not ok and (trial or failures >= 2):
                is_open, since = True, now
            trial = False if ok or is_open else trial
    assert got == sorted(want)
    assert table_of(events.stream_circuit_breaker(spark, SF)) == got


def test_state_is_kept_between_batches(spark, tmp_path):
    schema = "key string, seq long, t long, ok boolean"
    calls = [("m", i, t, ok) for i, (t, ok) in enumerate([(1, False), (2, False), (3, False), (10, True), (34, False), (40, True), (65, True), (66, True)])]
    for i in range(0, 8, 2):
        spark.createDataFrame(calls[i : i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds("t"))
    out = {r.seq: r.state for r in flows.run_to_table(flows.circuit_breaker(files, 3, 30), "append", str(tmp_path / "out")).collect()}
    assert [out[i] for i in range(8)] == ["CLOSED"] * 3 + ["OPEN", "HALF_OPEN", "OPEN", "HALF_OPEN", "CLOSED"]
