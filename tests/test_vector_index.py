"""The vector index: every row indexed, recall against exact search, filters, both ways of dealing questions out."""

import random

import pytest
from pyspark.sql import functions as F
from test_retrieval import rows

from sparkloom.operators import retrieve, vector_index

SCHEMA = "chunk_id long, embedding array<double>, tenant string, mark int"


@pytest.fixture(scope="module")
def held(spark):
    rng = random.Random(5)
    mid = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(12)]
    data = [(i, [c + rng.gauss(0, 1) for c in mid[i % 12]], ["a", "b", None, "\t"][i % 4], i % 3) for i in range(600)]
    bad = [(900, None, "a", 0), (901, [0.0] * 6, "a", 0), (902, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], "a", 0), (903, [1.0, 2.0], "a", 0), (904, [None] * 6, "a", 0)]
    asked = [(q, [c + rng.gauss(0, 1) for c in mid[q % 12]], ["a", "b", None, " "][q % 4]) for q in range(40)] + [(90, None, "a"), (91, [1.0], "a")]
    return spark.createDataFrame(data + bad, SCHEMA), spark.createDataFrame(asked, "query_id long, embedding array<double>, tenant string")


@pytest.mark.parametrize("measure", ["cosine", "ip", "l2"])
def test_recall_and_both_ways(spark, held, measure, monkeypatch):
    corpus, asked = held
    index = vector_index.build(corpus, measure=measure, tenant="tenant", cells=12)
    assert index.vectors().count() == 600 and index.recall >= 0.95 and 1 <= index.probes <= 12
    fine = corpus.where("chunk_id < 900")
    true = {r[:2] for r in rows(retrieve.vector_topk(asked.where("query_id < 90"), fine, 8, measure))}
    found = rows(vector_index.topk(index, asked, 8))
    assert len(found) == 320 and len(true & {r[:2] for r in found}) >= 0.9 * len(true)
    filters = {"tenant": "tenant", "live": F.col("mark") > 0}
    own = rows(vector_index.topk(index, asked, 8, **filters))
    assert own and all(q % 4 < 2 and c % 4 == q % 4 and c % 3 for q, c, _, _ in own)
    exact = {r[:3] for r in rows(retrieve.vector_topk(asked.where("query_id < 90"), fine, 600, measure))}
    assert {r[:3] for r in found + own} <= exact
    monkeypatch.setattr(vector_index, "QUESTIONS", 0)
    assert rows(vector_index.topk(index, asked, 8)) == found and rows(vector_index.topk(index, asked, 8, **filters)) == own


def test_cells_that_nobody_opens_are_not_read(spark, held):
    index = vector_index.build(held[0], cells=12)
    plan = vector_index.topk(index, held[1].limit(1), 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_an_index_is_opened_as_it_was_made(spark, held):
    index = vector_index.build(held[0], cells=5)
    again = vector_index.open_index(spark, index.path)
    assert again.probes == index.probes and (again.centres == index.centres).all()
    assert rows(vector_index.topk(again, held[1], 3)) == rows(vector_index.topk(index, held[1], 3))


def test_small_and_empty_tables(spark, held):
    corpus, asked = held
    for n in (0, 1, 3):
        index = vector_index.build(corpus.orderBy("chunk_id").limit(n))
        assert len(rows(vector_index.topk(index, asked, 5))) == 40 * n
    with pytest.raises(ValueError):
        vector_index.topk(index, asked, 5, tenant="tenant")


def test_cells_without_arrow(spark, held):
    """A cluster's session does not turn Arrow on."""
    before = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        assert vector_index.build(held[0], cells=12).vectors().count() == 600
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", before)
