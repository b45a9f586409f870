"""The pipeline's third stage leaves no shuffle files of its search behind."""

import random
import time

from sparkloom.llm import near_copies
from sparkloom.sources.scratch import shuffles_dropped

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_go_with_each_query_of_the_search(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(12)]
    docs = spark.createDataFrame([(i, t + f" e{i}") for i, t in enumerate(texts * 3)], "doc_id long, text string")
    before = shuffle_files(spark)
    out = near_copies.representatives(docs)
    for _ in range(50):  # files are removed in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left, len(left)
    assert spark.conf.get(CLEANUP, None) is None
    assert sorted(r.doc_id for r in out.collect()) == list(range(12))


def test_own_setting_stays(spark):
    spark.conf.set(CLEANUP, "false")
    try:
        with shuffles_dropped(spark):
            assert spark.conf.get(CLEANUP) == "false"
        assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)
