"""Packing: exact round trip, ids as the tokenizers library makes them, and the plan against plain best fit and brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import packing

SCHEMA = "doc_id bigint, text string, length int, salt int, rank int, piece string"


def by_letter():
    """A maker of encoders of one id per character; workers can't import this module, so it is a function of its own."""

    def letters():
        return lambda text: np.array([ord(c) + 3 for c in text], "<u4")

    return letters


letters = by_letter()


def rows(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, 1, 2, 3, "x") for i, t in enumerate(texts)], SCHEMA)


def check(found, texts, capacity):
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert len(by_doc) == len(texts)
    places = {}
    for doc, text in enumerate(texts):
        ids = np.append(letters()(text or ""), 2).astype("<u4")
        parts = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == np.cumsum([0] + [r["length"] for r in parts])[:-1].tolist()
        assert sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == capacity for r in parts[1:]) and 0 < parts[0]["length"] <= capacity
        for r in parts:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def plain_best_fit(lengths, capacity):
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in range(len(gaps)) if gaps[b] >= length]
        if fits:
            gaps[min(fits, key=lambda b: gaps[b])] -= length
        else:
            gaps.append(capacity - length)
    return len(gaps)


def test_every_piece_has_its_place(spark):
    random.seed(2)
    texts = ["a" * random.randint(0, 30) for _ in range(300)] + ["", None, "b" * 16, "b" * 15, "c" * 5_000] + ["same text"] * 40
    found = packing.pack(rows(spark, texts), 16, letters).collect()
    lengths = [x for t in texts for x in packing.cut_lengths(len(t or "") + 1, 16)]
    assert check(found, texts, 16) <= plain_best_fit(lengths, 16)


def test_reruns_agree_and_other_columns_do_no_harm(spark):
    texts = ["ab" * (i % 9) for i in range(60)]
    first = packing.pack(rows(spark, texts), 16, letters)
    again = packing.pack(rows(spark, texts).repartition(7), 16, letters)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert first.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    found = packing.pack(rows(spark, ["abc", "abc", "abcd", None], [None, None, 5, 5]), 16, letters).collect()
    assert len(found) == 4 and {r["sequence_id"] for r in found} == {0}
    assert sorted(r["offset"] for r in found)[0] == 0 and sum(r["length"] for r in found) == 14


def test_nothing_comes_of_an_empty_table(spark):
    assert packing.pack(rows(spark, []), 16, letters).count() == 0


def test_ids_are_those_of_the_tokenizers_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    random.seed(5)
    signs = [*"ab \n\t'12,.é中 　\r\x0b\x1c\x85", "'s", "'ll", "  ", "<|endoftext|>", "the", " of"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 60))) for _ in range(3_000)] + ["word " * 20_000]
    encode = packing.byte_bpe()
    for text, want in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
        assert encode(text).tolist() == want.ids
    found = packing.pack(rows(spark, texts[-2:])).collect()
    whole = np.append(slow.encode(texts[-1], add_special_tokens=False).ids, 2).astype("<u4")
    for r in (r for r in found if r["doc_id"] == 1):
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity:
                go(i + 1, bins[:b] + [bins[b] + lengths[i]] + bins[b + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_the_plan_uses_every_piece_once_and_few_sequences(lengths):
    patterns = packing.plan(Counter(lengths), 12)
    used = Counter()
    for pattern, times in patterns:
        assert times > 0 and sum(pattern) <= 12
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths)
    assert sum(t for _, t in patterns) <= fewest(sorted(lengths, reverse=True), 12) + (len(lengths) > 6)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
def test_counted_best_fit_is_best_fit_of_single_pieces(counts):
    single = plain_best_fit(Counter(counts).elements(), 40)
    left = np.zeros(41, np.int64)
    for length, n in counts.items():
        left[length] = n
    plain = packing._best_fit(left, 40)
    assert sum(t for _, t in plain) == single
    assert sum(t for _, t in packing.plan(counts, 40)) <= single


def test_the_plan_does_not_grow_with_the_counts():
    random.seed(3)
    counts = {x: random.randint(1, 10**10) for x in range(1, 1025)}
    patterns = packing.plan(counts)
    total = sum(k * v for k, v in counts.items())
    assert len(patterns) < 6 * 1024
    assert -(-total // 1024) <= sum(t for _, t in patterns) < total / 1024 * 1.1


def test_exact_complements_leave_no_gap():
    patterns = packing.plan({600: 10, 424: 4, 300: 3, 124: 3, 200: 6, 24: 3})
    assert sum(t for _, t in patterns) == 10
    assert ((600, 424), 4) in patterns and ((600, 300, 124), 3) in patterns and ((600, 200, 200, 24), 3) in patterns
