"""Containment without comparing all with all: equal to plain ``in``."""

import random

from sparkloom.operators import contain, inverted, retrieve


def test_containing_equals_in(spark, monkeypatch):
    monkeypatch.setattr(inverted, "CELL", 16)
    rng = random.Random(3)
    words = ["ab", "abc", "Bc", "c", "知识库", "库中", "x1", "é", "to"]
    texts = [(i, rng.choice(["", " "]).join(rng.choice(words) + rng.choice([" ", ", ", "\n", ""]) for _ in range(rng.randrange(0, 30)))) for i in range(70)] + [(90, None), (91, ""), (92, "needle in the hay" * 3_000)]
    needles = []
    for q in range(60):
        text = rng.choice(texts[:70])[1]
        a = rng.randrange(0, len(text) + 1)
        needles.append((q, text[a : a + rng.randrange(0, 40)]))
    needles += [(100, None), (101, ""), (102, "no such words are there"), (103, "edle in the hayneedle in the h"), (104, "c"), (105, " , ")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string")
    index = retrieve.index_chunks(chunks)
    found = contain.containing(chunks, spark.createDataFrame(needles, "query_id long, text string"), index)
    want = sorted((q, c) for q, n in needles for c, t in texts if n is not None and t is not None and n in t)
    assert sorted(map(tuple, found.collect())) == want and any(q == 103 for q, _ in want)
    # of an index that has been refreshed, what is live counts
    grown = inverted.delete(index, chunks.where("chunk_id < 30"))
    left = contain.containing(chunks.where("chunk_id >= 30"), spark.createDataFrame(needles, "query_id long, text string"), grown)
    assert sorted(map(tuple, left.collect())) == [p for p in want if p[1] >= 30]


def test_thousands_of_terms_equal_plain_in(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    terms = [(i, word(rng.randrange(2, 7))) for i in range(5_000)] + [(6_000, ""), (6_001, None), (6_002, "ABC"), (6_003, "a.c")]
    texts = [(i, word(rng.randrange(0, 80))) for i in range(40)] + [(50, None), (51, ""), (52, "xx AbC xx"), (53, "a.c")]
    t = spark.createDataFrame(terms, "term_id long, term string").repartition(3)
    d = spark.createDataFrame(texts, "id long, text string")
    for fold in (False, True):
        low = (lambda s: s.lower()) if fold else (lambda s: s)
        want = sorted((i, k) for i, x in texts for k, term in terms if x is not None and term is not None and low(term) in low(x))
        assert sorted(map(tuple, contain.terms_found(d, t, fold).collect())) == want
    monkeypatch.setattr(contain, "AUTOMATON", 9_000)  # several passes
    assert sorted(map(tuple, contain.terms_found(d, t, True).collect())) == want
    assert contain.terms_found(d, t.limit(0)).count() == 0 and contain.terms_found(d.limit(0), t).count() == 0
