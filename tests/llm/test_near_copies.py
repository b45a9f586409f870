"""The pipeline's near copies against brute force."""

import itertools
import random

import corpus_pipeline
from sparkloom.llm import near_copies


def jaccard(a, b):
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def texts_of(rng):
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 150))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(10_000)}"
            texts.append(" ".join(t + [f"e{rng.randrange(10_000)}" for _ in range(rng.randrange(6))]))
    texts += [" ".join(passage + [f"u{rng.randrange(10_000)}" for _ in range(k)]) for k in range(0, 24)]
    return [*texts, texts[0].upper(), "", " \n", None, "one", "One", "one two"]


def test_near_copies_against_brute_force(spark):
    texts = texts_of(random.Random(12))
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if jaccard(texts[i], texts[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == [i for i in range(len(texts)) if top(i) == i]
    assert len(kept) < len(texts) - 30


def test_near_copies_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, "a", "", "", 1), (None, "a", "", "", 1), (1, "a b", "", "", 1), (1, "a b", "", "", 1), (2, "A  b", "", "", 1), (3, "x", "", "", 1), (3, "y", "", "", 1)]
    kept = [r.doc_id for r in near_copies.representatives(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(-1 if i is None else i for i in kept) == [-1, -1, 1, 3]
    assert near_copies.representatives(spark.createDataFrame([], schema)).count() == 0
