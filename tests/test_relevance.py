"""Relevance is the whole benchmark text, not its beginning."""

from sparkloom.queries import retrieval


def test_only_whole_texts_are_relevant(spark, tmp_path):
    text = "A benchmark question that is much longer than forty characters, with an end of its own."
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, f"Before. {text} After.", "s"), (2, f"Before. {text[:40]} and something else", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.query_id, r.expected) for r in retrieval.cases(spark, str(tmp_path)).collect()] == [(1, [1])]
