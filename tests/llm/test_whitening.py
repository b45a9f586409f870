"""Whitening against dense linear algebra and exact whole numbers."""

import math
from fractions import Fraction

import numpy as np

from sparkloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x string, w int, deviation string, place int"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "x", 1, "d", 2) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(vectors):
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums)] for row in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, e[::-1], v[:, ::-1], float(Fraction(sum(deviation), n**3))


def held(found, k):
    w = {}
    for r in found:
        w.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    return np.array([[w[i][c] for c in range(1, k + 1)] for i in sorted(w)])


def test_equals_dense_algebra(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(200, 12)) * np.linspace(3, 0.5, 12) + 2).astype(np.float32).tolist()
    found = whitening.whiten(table(spark, vectors)).collect()
    deviation, centred, e, v, trace = brute(vectors)
    assert len(found) == 200 * 8 and {r["n"] for r in found} == {200}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == dict(enumerate(deviation))
    got, want = held(found, 8), centred @ v[:, :8] / np.sqrt(e[:8])
    for i in range(8):
        sign = np.sign(got[0, i] * want[0, i])
        assert np.allclose(got[:, i] * sign, want[:, i], atol=1e-9)
        assert np.isclose(next(r["explained"] for r in found if r["component"] == i + 1), e[i] / trace, rtol=1e-12)
    off = np.abs((got - got.mean(0)).T @ (got - got.mean(0)) / 200 - np.eye(8)).max()
    assert len({r["identity_error"] for r in found}) == 1 and abs(found[0]["identity_error"] - off) < 1e-12 and off < 1e-9


def test_rows_that_are_not_finite_or_not_there_go(spark):
    vectors = [[1.0, 2.0], [3.0, 1.0], [2.0, 5.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, -float("inf")]]
    found = whitening.whiten(table(spark, vectors)).collect()
    assert {r["vec_id"] for r in found} == {0, 1, 2} and {r["n"] for r in found} == {3} and {r["component"] for r in found} == {1, 2}


def test_null_ids_repeated_rows_and_shorter_vectors_count(spark):
    vectors = [[1.0, 2.0, 0.0], [1.0, 2.0], [1.0, 2.0], [4.0, 0.5, 7.0], []]
    found = whitening.whiten(table(spark, vectors, [7, None, 7, 8, 9])).collect()
    assert {r["n"] for r in found} == {5}
    full = [v + [0.0] * (3 - len(v)) for v in vectors]
    deviation = brute(full)[0]
    assert sorted(int(r["deviation"]) for r in found if r["component"] == 1) == sorted(deviation)
    assert sum(r["vec_id"] is None for r in found) == len({r["component"] for r in found})


def test_what_cannot_be_whitened_gives_no_rows(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 4, [[]]):
        out = whitening.whiten(table(spark, vectors))
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_flat_dimension_is_no_component(spark):
    vectors = [[float(i), 1.0, float(i * i % 7)] for i in range(20)]
    assert {r["component"] for r in whitening.whiten(table(spark, vectors)).collect()} == {1, 2}


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**30, 1.0], [-(2.0**30), 2.0], [5.0, 2.0**20]]
    found = whitening.whiten(table(spark, vectors)).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == dict(enumerate(brute(vectors)[0]))


def test_entries_beyond_all_bounds_do_not_crash(spark):
    found = whitening.whiten(table(spark, [[3e38, 1.0], [-3e38, 0.0], [1.0, 2.0]])).collect()
    assert found and all(np.isfinite(r["whitened"]) for r in found)
