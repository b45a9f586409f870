"""SimHash goes first in the pipeline's third stage, and the set-similarity join after it loses nothing."""

import random

from sparkloom.llm import near_copies, simhash


def test_simhash_links_come_first_and_the_rest_from_the_join(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(300)]
    close = [*base[:-1], "other"]  # a shingle differs: a few bits at most
    far = [w if i % 45 else f"x{i}" for i, w in enumerate(base)]  # about 0.8 of the shingles, many bits
    texts = [" ".join(base), " ".join(close), " ".join(far), "something else that stands alone here"]
    assert near_copies.similar(texts[0], texts[1]) and near_copies.similar(texts[0], texts[2])
    h = [near_copies._simhash(near_copies.hashes(near_copies.words_of(t))) for t in texts]
    assert bin((h[0] ^ h[1]) & (2**64 - 1)).count("1") <= near_copies.BITS < bin((h[0] ^ h[2]) & (2**64 - 1)).count("1")
    seen, real = [], near_copies._verified

    def told(pairs, *rest):
        found = real(pairs, *rest)
        seen.append({tuple(r) for r in found.collect()})
        return found

    calls = []
    monkeypatch.setattr(near_copies, "_verified", told)
    for name in ("neighbour_links", "links"):
        monkeypatch.setattr(simhash, name, lambda *a, _f=getattr(simhash, name), _n=name, **k: calls.append(_n) or _f(*a, **k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_copies.representatives(docs).collect())
    assert kept == [0, 3] and calls == ["neighbour_links", "links"]
    assert (0, 1) in seen[0] | seen[1] and (0, 2) not in seen[0] | seen[1]
