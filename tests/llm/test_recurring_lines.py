"""Line dedup: what must not depend on the size of the table."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def drop(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}


def test_fields_whose_values_recur(spark):
    names, cities = [f"name{c}" for c in "abcdefghij"], [f"city{c}" for c in "klmnopqrst"]
    lines = [f"Posted on 2024-01-{i % 28} by user {names[i % 10]} from {cities[(i // 10) % 10]}" for i in range(200)]
    fresh = [f"own{i} words" for i in range(200)]
    out = drop(spark, [f"{f}\n{x}" for f, x in zip(fresh, lines)])
    assert [i for i in range(200) if "Posted" in out[i]] == [0]
    assert all(out[i] == fresh[i] for i in range(1, 200))


def test_equal_lines_of_a_mixed_leaf_and_edges(spark):
    same = [f"We all know word{c} other{c} third{c} fourth{c}" for c in "abcdefghij" for _ in range(3)]
    out = drop(spark, [f"own{i} words\n{x}" for i, x in enumerate(same)])
    assert [i for i in range(30) if "\n" in out[i]] == list(range(0, 30, 3))
    assert drop(spark, [None, "", "a b c", "a b c"]) == {0: None, 1: "", 2: "a b c", 3: "a b c"}
    assert drop(spark, []) == {}


def test_short_lines_recur(spark):
    out = drop(spark, [f"own{i} words\nLes.\nAnd  ornd.\nNo {i}\n\nlast own{i} line" for i in range(4)])
    assert "Les." in out[0] and "ornd." in out[0]
    assert [out[i] for i in (1, 2, 3)] == [f"own{i} words\nNo {i}\n" for i in (1, 2, 3)]


def test_long_lines_recur_from_two_texts(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    out = drop(spark, [f"own a b\n{passage}", f"other c d\n{passage}\nfew words only", "some words\nfew words only", f"other c d\n{passage}\nfew words only"])
    assert passage in out[0] and out[2].endswith("few words only")
    assert out[1] == out[3] == "other c d\nfew words only"
