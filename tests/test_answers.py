"""Answers in parts and the sink that writes once: any order, any batches, repeats, failures."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import answers, flows, ledger

DAY0 = 19_675 * 86_400
SCHEMA = "conv_id long, part long, kind string, text string, s long"
PARTS = [
    *[(1, i, "TOKEN", t, i) for i, t in enumerate(["Hel", "lo", "", " there"])], (1, 4, "END", "trace 1", 5),
    (2, 0, "TOKEN", "compet", 1), (2, 1, "TOKEN", "itor_x is", 2), (2, 2, "END", "trace 2", 3),
    (3, 0, "TOKEN", "half an ans", 1), (3, 1, "ERROR", "model failed", 2), (3, 1, "END", "late", 3),
    (4, 0, "TOKEN", "never ends", 1), (4, 2, "TOKEN", "one is missing", 1),
    (5, 0, "END", "", 1), (6, 0, "TOKEN", "tool", 1), (6, 1, "END_TOOL", "", 1), (7, 0, "TOKEN", "tool", 1), (7, 1, "END_TOOL", "called", 2),
    (8, 1, "END", "", 4), (8, 0, "TOKEN", None, 1), (9, 2, "END", "t", 1), (9, 0, "TOKEN", "a", 1),
]
M, D = "message", "[DONE]"
WANT = {
    1: [(M, "Hel"), (M, "lo"), (M, " there"), ("TRACE", "trace 1"), (M, D)], 2: [(M, answers.SAFE), ("TRACE", "trace 2"), (M, D)], 3: [("ERROR", "model failed")],
    4: [("ERROR", answers.SILENT)], 5: [("TRACE", ""), (M, D)], 6: [(M, "tool"), (M, D)], 7: [(M, "tool"), ("TOOL_CALL", "called"), (M, D)], 8: [("TRACE", ""), (M, D)], 9: [("ERROR", answers.SILENT)],
}


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds(F.col("s") + DAY0)).drop("s")


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.conv_id, r.seq)):
        out.setdefault(r.conv_id, []).append((r.event, r.data))
        assert r.seq == len(out[r.conv_id]) - 1
    return out


def stream_of(spark, path, batches):
    for rows in batches:
        table(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(table(spark, PARTS[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_table_of_parts(spark):
    rows = PARTS * 2
    random.Random(1).shuffle(rows)
    assert told(answers.frames_of_all(table(spark, rows), ("competitor_x",))) == WANT
    assert answers.frames_of_all(table(spark, []), ("x",)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_parts_over_several_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    parts = [p for p in PARTS if p != (3, 1, "END", "late", 3)]  # an end may come before the error, and then is one
    rows = parts + rng.sample(parts, 8)
    rng.shuffle(rows)
    clock = [(-1, 0, "TOKEN", "", 100_000)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = stream_of(spark, path, [rows[i::4] for i in range(3)] + [rows[3::4], clock] if seed == 1 else [rows, clock])
    found = told(flows.run_to_table(answers.frames(stream, ("competitor_x",), 60), "append", out))
    assert found == WANT
    left = spark.read.format("statestore").option("stateVarName", "about").load(f"{out}-state")
    assert left.count() == 1  # the clock itself


def test_what_comes_after_the_end_is_not_sent_again(spark, tmp_path):
    batches = [[(1, 0, "TOKEN", "a", 1), (1, 1, "END", "t", 1)], [(1, 0, "TOKEN", "b", 2), (1, 1, "END", "u", 2), (1, 5, "ERROR", "x", 2)]]
    out = told(flows.run_to_table(answers.frames(stream_of(spark, str(tmp_path / "in"), batches)), "append", str(tmp_path / "out")))
    assert out == {1: [(M, "a"), ("TRACE", "t"), (M, D)]}


def test_a_batch_is_written_once(spark, tmp_path):
    path, schema = str(tmp_path / "audit"), "id long"
    rows = spark.range(5)
    assert ledger.put_once(rows, 0, path) == ledger.WRITTEN
    assert ledger.put_once(rows, 0, path) == ledger.WRITTEN  # run again after a crash
    ledger.put_once(spark.range(5, 7), 1, path)
    spark.range(9).write.parquet(f"{path}/data/2")  # begun, but not in the ledger
    assert sorted(r[0] for r in ledger.written(spark, path, schema).collect()) == list(range(7))
    ledger.put_once(spark.range(7, 8), 2, path)
    assert sorted(r[0] for r in ledger.written(spark, path, schema).collect()) == list(range(8))
    assert [(r.batch, r.state, r.n) for r in ledger.entries(spark, path).orderBy("batch").collect()] == [(0, "WRITTEN", 5), (1, "WRITTEN", 2), (2, "WRITTEN", 1)]


def test_a_sink_that_fails_is_counted_and_does_not_stop_the_stream(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    path = str(tmp_path / "audit")
    calls = []

    def write(rows, place):
        calls.append(place)
        if place.endswith("/1"):
            raise OSError("disk is full")
        rows.write.parquet(place)

    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger.run(stream, path, write=write)
    states = {r.batch: (r.state, r.n, r.error) for r in ledger.entries(spark, path).collect()}
    assert states == {0: ("WRITTEN", 4, None), 1: ("DROPPED", 4, "OSError: disk is full"), 2: ("WRITTEN", 4, None)}
    assert ledger.written(spark, path, "id long").count() == 8 and len(calls) == 3
    ledger.run(stream, path, write=write)  # nothing new
    assert len(calls) == 3
    assert ledger.put_once(spark.range(4), 1, path, write) == ledger.DROPPED and len(calls) == 3


def test_nothing_written_is_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "audit")

    def write(rows, place):
        raise RuntimeError("no")

    ledger.put_once(spark.range(1), 0, path, write)
    out = ledger.written(spark, path, "id long")
    assert out.columns == ["id"] and out.count() == 0
