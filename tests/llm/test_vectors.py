"""Centroid clustering and whitening against plain versions, on vectors with awkward cases."""

from __future__ import annotations

from fractions import Fraction
from hashlib import sha256
from math import floor, isfinite

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import clustering, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, VEC_ID string"
D = 6


def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (5, D))
    rows = [(i, [float(np.float32(c)) for c in centres[i % 5] + rng.normal(0, 0.5, D)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a hot vector
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (None, [0.25] * D)]  # repeated ids, no ids
    rows += [(2000 + i, [0.5 * ((i >> k) & 1) for k in range(D)]) for i in range(64)]  # many ties
    rows += [(3000, None), (3001, [1.0] * (D - 1) + [float("nan")]), (3002, [1.0] * (D - 1) + [float("inf")]), (3003, [None] + [1.0] * (D - 1))]
    return [(i, v, 1, "x") for i, v in rows]


def good(rows, size=None):
    return [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and isfinite(c) for c in v) and (size is None or len(v) == size)]


def plain_clusters(rows, k, rounds):
    x = [(i, tuple(floor(64 * c) for c in v)) for i, v in good(rows, D)]
    key = lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(x, key=key)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in x]
    for _ in range(rounds):
        own = nearest()
        for j in range(len(centroids)):
            if mine := [v for (_, v), (_, c) in zip(x, own, strict=True) if c == j]:
                centroids[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    own = nearest()
    total = sum(d for d, _ in own)
    sums = [sum(d for d, c in own if c == j) for j in range(len(centroids))]
    digest = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), c, d, sums[c], total, digest[c]) for (i, _), (d, c) in zip(x, own, strict=True))


def found(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.mark.parametrize(("k", "rounds"), [(16, 3), (3, 1), (1, 2), (500, 1)])
def test_clusters_equal_the_plain_rounds(spark, k, rounds):
    rows = [*vectors(), (4000, [1.0] * (D + 1), 1, "x"), (4001, [], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = clustering.clusters(df, k, rounds, size=D)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert found(out) == plain_clusters(rows, k, rounds)


def test_clusters_of_few_and_no_vectors(spark):
    few = vectors()[:3]
    assert found(clustering.clusters(spark.createDataFrame(few, SCHEMA), size=D)) == plain_clusters(few, 16, 3)
    assert clustering.clusters(spark.createDataFrame([], SCHEMA), size=D).count() == 0


def test_a_component_beyond_any_long_distance_is_named(spark):
    df = spark.createDataFrame([(77, [1e12] + [0.0] * (D - 1), 1, "x")], SCHEMA)
    with pytest.raises(Exception, match="77"):
        clustering.clusters(df, size=D).collect()


@given(st.integers(0, 2**32 - 1), st.integers(1, 12), st.integers(2, 5), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_bounds_never_lose_a_tie(seed, k, size, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2 - spread * 50, 3 + spread * 50, (80, size))
    before = rng.integers(-2, 3, (k, size))
    cluster, upper, lower = np.full(80, -1), np.zeros(80), np.zeros((80, k))
    for _ in range(4):
        cluster, _ = clustering.reassigned(x, before, cluster, upper, lower)
        d = ((x[:, None] - before[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()  # argmin takes the first of equals
        assert (upper >= np.sqrt(d[np.arange(80), cluster])).all() and (lower <= np.sqrt(d)).all()
        after = before + rng.integers(-2, 3, (k, size))
        clustering.moved(upper, lower, cluster, before, after)
        before = after


def test_bounds_save_most_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 64))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-64, 65, (2000, 64))
    cluster, upper, lower = np.full(2000, -1), np.zeros(2000), np.zeros((2000, 16))
    cluster, first = clustering.reassigned(x, centres, cluster, upper, lower)
    clustering.moved(upper, lower, cluster, centres, centres + 1)
    _, again = clustering.reassigned(x, centres + 1, cluster, upper, lower)
    assert first < 16 * 2000 and again == 0


def plain_whitening(rows, most):
    x = [(i, [floor(64 * c) + 1_000_000 for c in v]) for i, v in good(rows)]
    fit = [list(v) for v in {tuple(v) for _, v in x}]
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = [Fraction(t, n) for t in s]
    centred = [[Fraction(a) - m for a, m in zip(v, mean, strict=True)] for v in fit]
    v = np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(D)] for i in range(D)])
    values, vecs = np.linalg.eigh(v)
    order = np.argsort(-values)[:most]
    deviation = [sum((n * a - t) ** 2 for a, t in zip(w, s, strict=True)) for _, w in x]
    w = np.array([[float(a - m) for a, m in zip(u, mean, strict=True)] for _, u in x]) @ vecs[:, order] / np.sqrt(values[order])
    return x, n, deviation, w, values[order] / np.trace(v)


def test_whitening_equals_exact_covariance(spark):
    rows = vectors()
    x, n, deviation, w, explained = plain_whitening(rows, 4)
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5), 4).collect()
    assert len(got) == 4 * len(x) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4}
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got) == sorted((str(i), d) for (i, _), d in zip(x, deviation, strict=True) for _ in range(4))
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in got)
    for c in range(4):
        mine = sorted((str(r["vec_id"]), int(r["deviation"]), r["whitened"]) for r in got if r["component"] == c + 1)
        want = sorted((str(i), d, p) for (i, _), d, p in zip(x, deviation, w[:, c], strict=True))
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(mine, want, strict=True)))
        if not np.allclose([a[2] for a in mine], [sign * b[2] for b in want], atol=1e-7):  # equal ids and deviations may be in another order
            assert np.allclose(np.sort([a[2] for a in mine]), np.sort([sign * b[2] for b in want]), atol=1e-7)


def test_whitening_without_spread_or_rows(spark):
    one = spark.createDataFrame([(1, [0.5] * D, 1, "x"), (2, [0.5] * D, 1, "y")], SCHEMA)
    assert whitening.whitened(one).count() == 0 == whitening.whitened(spark.createDataFrame([], SCHEMA)).count()
    flat = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 2)], 1, "x") for i in range(12)], SCHEMA)
    got = whitening.whitened(flat).collect()
    assert {r["component"] for r in got} == {1, 2} and {r["n"] for r in got} == {6} and max(r["identity_error"] for r in got) < 1e-9
    with pytest.raises(ValueError, match="from 2 to 3"):
        whitening.whitened(spark.createDataFrame([(1, [0.5] * 2, 1, "x"), (2, [0.5] * 3, 1, "x")], SCHEMA))


def test_whitening_is_exact_far_from_the_origin(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(1000 + c)) for c in rng.normal(0, 0.2, 3)], 1, "x") for i in range(200)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(4), 3).collect()
    assert max(r["identity_error"] for r in got) < 1e-9
