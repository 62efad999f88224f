"""Whole-number k-means against plain Python, and odd vectors."""

import hashlib
import math

import numpy as np
import pytest

from lexatlas.llm.clustering import cluster_vectors, nearest, occurring

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, clusters, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centres = [v for _, v in sorted(kept, key=key)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    own = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        of = [own(v) for _, v in kept]
        for c in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, own(v), far(v, centres[own(v)])) for i, v in kept]
    sums = {c: sum(d for _, o, d in out if o == c) for _, c, _ in out}
    digest = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest(c)) for i, c, d in out), key=repr)


def found(spark, rows, **options):
    out = cluster_vectors(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in out.collect()), key=repr)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.4, 6).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]  # copies: empty clusters and ties
    assert found(spark, rows, clusters=25, rounds=4, dims=6, step=17) == brute(rows, 25, 4, 6)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [0.5, -0.001]), (6, [0.5, -0.001]), (None, [3000.25, -7.5]), (8, [0.0, 0.0]), (9, [])]
    assert found(spark, rows, clusters=3, rounds=2, dims=2) == brute(rows, 3, 2, 2)
    assert found(spark, rows, clusters=40, rounds=2, dims=2) == brute(rows, 40, 2, 2)
    assert cluster_vectors(spark.createDataFrame([], SCHEMA), dims=2).count() == 0
    wide = spark.createDataFrame([(1, [0.5, 0.5], 3, [1], 7)], "vec_id long, embedding array<float>, cluster int, v array<int>, inertia int")
    assert cluster_vectors(wide, dims=2).first()["cluster"] == 0


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="or more"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], SCHEMA), dims=2).count()


def test_tables_equal_plain_distances():
    rng = np.random.default_rng(1)
    for spread in (40, 10**7):
        x, c = rng.integers(-spread, spread, (500, 8)), rng.integers(-spread, spread, (9, 8))
        own, far = nearest(x, c)
        plain = ((x[:, None] - c[None]) ** 2).sum(2)
        assert (own == plain.argmin(1)).all() and (far == plain.min(1)).all()
        values, place = occurring(x[:, 0])
        assert (values[place] == x[:, 0]).all() and (values == np.unique(x[:, 0])).all()
