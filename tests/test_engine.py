"""The engine's own operators: exact values, and every query against its SQL."""

import duckdb
import pytest

from sparkloom.functions import text as T
from sparkloom.operators import chunking, evaluate, fusion, metering
from sparkloom.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def hits(spark, ids):
    return spark.createDataFrame([(1, c, 1.0, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id string, score double, rank int")


@pytest.mark.parametrize(("v", "b", "first", "n"), [(["a"], ["x", "a"], "a", 2), (["v1", "a"], ["b1", "a"], "a", 3), (["v1"], [], "v1", 1), ([], [], None, 0)])
def test_fusion(spark, v, b, first, n):
    out = fusion.fuse(hits(spark, v), hits(spark, b)).orderBy("fused_rank").collect()
    assert len(out) == n and (not out or out[0].chunk_id == first)
    if (v, b) == (["a"], ["x", "a"]):
        assert abs(out[0].fusion_score - (1 / 61 + 1 / 62)) < 1e-12 and (out[0].vector_rank, out[0].bm25_rank) == (1, 2)


def test_rerank_degraded(spark):
    s = dict(zip("abcdefg", (0.010, 0.030, 0.005, 0.025, 0.020, 0.015, 0.008)))
    df = spark.createDataFrame([(1, k, v, i) for i, (k, v) in enumerate(s.items())], "query_id long, chunk_id string, fusion_score double, fused_rank int")
    assert [r.chunk_id for r in fusion.rerank_degraded(df).orderBy("final_rank").collect()] == list("bdefa")


@pytest.mark.parametrize(("got", "want", "recall", "rr", "cp"), [("abc", "ab", 1, 1, 1), ("axy", "ab", 0.5, 1, 0.5), ("xy", "a", 0, 0, 0), ("a", "", None, None, None), ("xya", "a", 1, 1 / 3, 1 / 3), ("xba", "ab", 1, 0.5, (1 / 2 + 2 / 3) / 2), ("axb", "ab", 1, 1, (1 + 2 / 3) / 2)])
def test_metrics(spark, got, want, recall, rr, cp):
    cases = spark.createDataFrame([(1, list(want))], "query_id long, expected array<string>")
    r = evaluate.metrics(cases, hits(spark, list(got))).first()
    for value, expected in ((r.recall, recall), (r.reciprocal_rank, rr), (r.context_precision, cp)):
        assert value == expected if expected is None else abs(value - expected) < 1e-12


def test_sanitize(spark):
    from pyspark.sql import functions as F

    rows = [("13812345678",), ("110101199003077758",), ("zhang.san@corp.com",), ("1234567890123456789",), (None,)]
    out = [r[0] for r in spark.createDataFrame(rows, "t string").select(T.sanitize(F.col("t"))).collect()]
    assert out == ["1***-****-****", "*" * 18, "***@***.***", "1234567890123456789", None]
    assert T.terms(" a, ,B,") == ["a", "b"] and T.terms(" , ") == []


def test_splitting():
    table = "<table><tr><td>" + "cell words " * 6 + "</td></tr></table>"
    out = chunking.split_page(f"<p>{'Some text here. ' * 20}</p>{table}<img src='pic.png'><table><tr><td>x</td></tr></table>")
    kinds = [k for _, k, _ in out]
    assert kinds.count("TABLE") == 1 and kinds.count("IMAGE") == 1 and "TEXT" in kinds
    assert next(o for _, k, o in out if k == "TABLE").startswith("<table>") and "pic.png" in next(o for _, k, o in out if k == "IMAGE")
    text = "A sentence of some words. " * 500
    pieces = chunking.split_tokens(text)
    assert len(pieces) > 1 and sum(map(len, pieces)) >= 0.85 * len(text) and chunking.split_page("A short sentence.") == [("A short sentence.", None, None)]
    assert chunking.split_page(None) == [] == chunking.split_page("  ")


def test_circuit_breaker(spark):
    from pyspark.sql import functions as F

    seq = [(1, False), (2, False), (3, False), (10, True), (34, False), (40, True), (65, True), (66, True)]
    rows = spark.createDataFrame([("m", i, t, ok) for i, (t, ok) in enumerate(seq)], "key string, seq long, t long, ok boolean")
    out = metering.circuit_breaker(rows.withColumn("ts", F.timestamp_seconds("t")), 3, 30).orderBy("seq").collect()
    assert [r.state for r in out] == ["CLOSED"] * 3 + ["OPEN", "HALF_OPEN", "OPEN", "HALF_OPEN", "CLOSED"]
    assert [r.primary_asked for r in out] == [True, True, True, False, True, False, True, True]


def _rows(rows):
    return sorted(tuple(repr(float(f"{x:.9g}")) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert _rows(df.select(*cols).collect()) == _rows([tuple(r[names.index(c)] for c in cols) for r in found.fetchall()])
