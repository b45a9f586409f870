"""What a request costs in the chain: the guards' folds run once, and one that is turned away carries no evidence. Fast paths of masks and words change nothing."""

import re

from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import advisors, retrieve


def test_folds_run_once_and_the_rejected_carry_no_evidence(spark):
    asked = [(1, "t", 0, 60, "what is alpha"), (2, "t", 1, 60, "what is beta"), (3, "t", 2, 5, "what is alpha"), (4, None, 3, 5, "what is beta")]
    requests = spark.createDataFrame(asked, "event_id long, tenant string, s long, tokens long, text string").withColumn("ts", F.timestamp_seconds("s")).withColumn("question", F.xxhash64("text"))
    chunks = spark.createDataFrame([(1, "alpha is a word"), (2, "beta is fine")], "chunk_id long, text string")
    index = retrieve.index_chunks(chunks)
    steps = [advisors.audit(), advisors.guards(100, 3, 60), advisors.retrieval(lambda q: retrieve.bm25_topk(index, q), chunks)]
    out = advisors.answer(requests, steps, lambda r: r.select("event_id", F.col("first").alias("answer")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # neither the folds of the tenants nor the search are made for each use
    rows = {r.event_id: (r.status, r.n_evidence, r.first, r.prompt is None) for r in out.collect()}
    assert rows == {
        1: ("SUCCESS", 2, "alpha is a word", False), 2: ("SUCCESS", 2, "beta is fine", False),
        3: ("REJECTED", 0, None, True), 4: ("REJECTED", 0, None, True),
    }


def test_masks_look_only_where_something_can_be(spark):
    texts = ["13812345678", "x13812345678.", "113812345678", "11010119900307123X", "1101011990030712345", "mail a.b-c@d-e.org now", "13812345678@x.org", "a@b", "1234567890", "", None, "١٣٨١٢٣٤٥٦٧٨"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def want(t):
        if t is None:
            return None
        t = re.sub(r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])", T.PHONE_MASK, t)
        t = re.sub(r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9Xx])", T.ID_MASK, t)
        return re.sub(r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[a-zA-Z]{2,}", T.EMAIL_MASK, t)

    assert [r[0] for r in df.select(T.sanitize(F.col("t"))).collect()] == [want(t) for t in texts]


def test_words_with_and_without_han(spark):
    texts = ["Plain words, 12x", "Grüße ÄÖİ", "知识库 and 库", "ひらがな カタカナ 々 〇", "😀 smile 𠀀𠀁𠀂", "한국어 글", "--", "", None]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens(F.col("t"))).collect()]
    assert out[0] == ["plain", "words", "12x"] and out[2] == ["知识", "识库", "and", "库"] and out[4] == ["smile", "𠀀𠀁", "𠀁𠀂"]
    assert out[1][0] == "grüße" and out[3] == ["ひらがな", "カタカナ", "々", "〇"] and out[5] == ["한국어", "글"] and out[6:] == [[], [], None]
