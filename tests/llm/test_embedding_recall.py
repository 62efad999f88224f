"""Links of vectors that fill few dimensions, against brute force."""

import numpy as np
import pytest

from lexatlas.llm.embedding_links import ProductQuantiser, link_embeddings


def vectors(kind, n, rng):
    if kind == "gaussian":
        x = rng.normal(size=(n, 64))
    elif kind == "low rank and noise":
        x = 3 * rng.normal(size=(n, 16)) @ rng.normal(size=(16, 768)) / 4 + rng.normal(size=(n, 768))
    elif kind == "clusters":
        x = rng.normal(size=(50, 64))[rng.integers(0, 50, n)] + 0.5 * rng.normal(size=(n, 8)) @ rng.normal(size=(8, 64))
    else:
        x = rng.normal(size=(n, kind)) @ np.linalg.qr(rng.normal(size=(64, kind)))[0].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = x[: n // 4]
    u = x[n // 4 : 2 * (n // 4)][: len(v)] - v
    u -= (u * v).sum(1, keepdims=True) * v
    return np.concatenate([x, 0.905 * v + np.sqrt(1 - 0.905**2) * u / np.linalg.norm(u, axis=1, keepdims=True)])


@pytest.mark.parametrize("kind", ["gaussian", 16, 8, 4, 2, "low rank and noise", "clusters"])
def test_probed_lists_hold_the_neighbours(kind):
    rng = np.random.default_rng(8)
    x = vectors(kind, 6000, rng)
    pq = ProductQuantiser(x[rng.permutation(len(x))], round(len(x) ** 0.5), 8, 64)
    pq.measure(x, 0.9, 1.25)
    own = (x @ pq.centres.T).argmax(1)
    asks = np.zeros((len(x), len(pq.centres)), bool)
    for i, p in enumerate(pq.probes(x, 0.9)):
        asks[i, p] = True
    found = links = 0
    for at in range(0, len(x), 1000):
        i, j = np.nonzero(x[at : at + 1000] @ x.T >= 0.9)
        i, j = (i + at)[i + at < j], j[i + at < j]
        links += len(i)
        found += int((asks[i, own[j]] | asks[j, own[i]]).sum())
    assert links >= 1400 and found >= 0.9995 * links


@pytest.mark.parametrize("kind", [4, 8])
def test_links_of_subspaces(spark, kind):
    x = vectors(kind, 1600, np.random.default_rng(kind)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (y @ y.T >= 0.9).sum(1) - 1
    assert sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= want[i] for i in got)
