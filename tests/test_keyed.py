"""Changes rewrite the buckets that they touch, twice is once, and bucketed tables meet without a shuffle."""

import glob
import os

from sparkloom.operators import documents
from sparkloom.sources import keyed

SCHEMA = "id long, v string"


def rows(t):
    return sorted(((r.id, r.v) for r in t.read().collect()), key=str)


def state(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/_bucket=*/*.parquet")}


def test_upserts_and_deletes_touch_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    t = keyed.create(spark.createDataFrame([(i, "old") for i in range(40)] + [(None, "old")], SCHEMA), path, "id", 8)
    want = {i: "old" for i in range(40)} | {None: "old"}
    before = state(path)
    touched = t.upsert(spark.createDataFrame([(3, "new"), (77, "new")], SCHEMA))
    want |= {3: "new", 77: "new"}
    assert rows(t) == sorted(want.items(), key=str) and 1 <= len(touched) <= 2
    left = lambda s: {f: m for f, m in s.items() if not any(f"_bucket={b}/" in f for b in touched)}
    assert left(before) == left(state(path)) and left(before)
    t.upsert(spark.createDataFrame([(3, "new"), (77, "new")], SCHEMA))
    assert rows(t) == sorted(want.items(), key=str)
    before = state(path)
    gone = spark.createDataFrame([(5,), (None,), (1_000,)], "id long")
    touched = t.delete(gone)
    del want[5], want[None]
    assert rows(t) == sorted(want.items(), key=str) and left(before) == left(state(path))
    after = state(path)
    assert t.delete(gone) == [] and state(path) == after
    assert keyed.open_table(spark, path) == t
    assert sorted(r.id for r in t.of(spark.createDataFrame([(3,), (9,), (5,)], "id long")).collect()) == [3, 9]


def test_a_bucket_of_which_nothing_is_left(spark, tmp_path):
    t = keyed.create(spark.createDataFrame([(i, "x") for i in range(6)], SCHEMA), str(tmp_path / "t"), "id", 3)
    t.delete(spark.createDataFrame([(i,) for i in range(6)], "id long"))
    assert rows(t) == []
    t.append(spark.createDataFrame([(9, "y")], SCHEMA))
    assert rows(t) == [(9, "y")]


def test_a_cascade(spark, tmp_path):
    a = keyed.create(spark.createDataFrame([(i, "a") for i in range(9)], SCHEMA), str(tmp_path / "a"), "id", 4)
    b = keyed.create(spark.createDataFrame([(i % 3, i) for i in range(9)], "doc long, n long"), str(tmp_path / "b"), "doc", 4)
    gone = spark.createDataFrame([(1,), (8,)], "doc_id long")
    keyed.cascade({"a": a, "b": b}, gone, "doc_id")
    assert [r[0] for r in rows(a)] == [0, 2, 3, 4, 5, 6, 7] and sorted(r.doc for r in b.read().collect()) == [0, 0, 0, 2, 2, 2]
    assert keyed.cascade({"a": a, "b": b}, gone, "doc_id") == {"a": [], "b": []}


def test_bucketed_tables_are_joined_without_an_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sessions = keyed.bucketed(spark.range(50).selectExpr("id as session", "'u' as owner"), "loom_sessions", "session", str(tmp_path / "s"), 4)
        messages = keyed.bucketed(spark.range(200).selectExpr("id % 50 as session", "id as n"), "loom_messages", "session", str(tmp_path / "m"), 4)
        both = messages.join(sessions, "session").groupBy("session").count()
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 50 and {r["count"] for r in both.collect()} == {4}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("loom_sessions", "loom_messages"):
            spark.sql(f"drop table if exists {name}")


def test_bulk_failures_shows_the_smallest_ids(spark):
    data = [("a", i, "e" if i % 2 else None) for i in range(500)] + [("b", 1, None), (None, 7, "e"), (None, 3, "e"), (None, 7, "e")]
    out = {r.by: (r["items"], r.failed, r.examples) for r in documents.bulk_failures(spark.createDataFrame(data, "by string, id long, error string"), "by").collect()}
    assert out == {"a": (500, 250, [1, 3, 5, 7, 9]), "b": (1, 0, []), None: (3, 3, [3, 7])}
