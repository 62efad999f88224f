"""Centroid clustering of integer vectors by scalar lookup tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Components up to this size keep squared distances of 64 components within a long.
LARGEST = 1 << 27


def quantise(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors (vec_id, embedding) that have exactly ``dims``
    components, none null or non-finite."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fits = (F.size("embedding") == dims) & F.forall("embedding", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(e * float(scale)))
    checked = F.when(F.forall(x, lambda e: F.abs(e * float(scale)) < float(LARGEST)), whole).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")))
    return vectors.where("embedding is not null").where(fits).select("vec_id", checked.cast("array<bigint>").alias("v"))


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column in ascending order, and each row's place among them."""
    low, span = int(column.min()), int(column.max() - column.min()) + 1
    if span > 4 * len(column) + 1024:
        return np.unique(column, return_inverse=True)
    seen = np.zeros(span, bool)
    seen[column - low] = True
    return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[column - low]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row. Per dimension the squared differences of the occurring values to all
    centroids are tabulated once; a row's distances are the sum of its tables' lines. Ties go to the smaller number."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for d in range(x.shape[1]):
        values, place = occurring(x[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        total += table[place]
    own = total.argmin(1)
    return own, total[np.arange(len(x)), own]


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def cluster_vectors(
    vectors: DataFrame, clusters: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:", step: int = 4096,
) -> DataFrame:
    """K-means of ``vectors`` (vec_id, embedding, ...) in whole numbers, the same on any number of machines.

    Components become floor(scale * x). Centroids start as the ``clusters`` vectors with the smallest SHA-256 of ``seed`` and
    vec_id. Each round assigns every vector to its nearest centroid by lookup tables (``nearest``, ``step`` rows at a time)
    and replaces each centroid that has vectors by the exact floor of their mean; then vectors are assigned once more.
    Tasks return one sum per cluster; clusters x dims numbers pass through the driver.

    Returns one row per kept vector: vec_id, cluster, distance (squared), cluster_inertia and inertia (distances summed over
    the cluster and over all), centroid_sha256 (of the final centroid's components, decimal, joined by commas) and
    cluster_size. Vectors that are null, of another length, or hold null or non-finite components are left out; components
    too large for exact distances raise an error. Repeated vec_ids are vectors of their own, among equal hashes ordered by
    their components; a null vec_id is hashed as an empty one. With fewer vectors than clusters each is a centroid;
    an empty table gives an empty result. Other columns are ignored.
    """
    kept = materialize(quantise(vectors, dims, scale))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(hashed, "v").limit(clusters).select("v").collect()
    centroids = np.array([r["v"] for r in start], np.int64).reshape(-1, dims)
    k = len(centroids)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch, dims)
            for at in range(0, len(x), step):
                rows = x[at : at + step]
                own = nearest(rows, centroids)[0]
                np.add.at(sums, own, rows)
                counts += np.bincount(own, minlength=k)
        seen = np.flatnonzero(counts)
        if len(seen):
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.int32()), pa.array(counts[seen]), pa.array(list(sums[seen]), pa.list_(pa.int64()))], ["cluster", "n", "sums"]
            )

    for _ in range(rounds if k else 0):
        parts = kept.select("v").mapInArrow(partial_sums, "cluster int, n long, sums array<long>")
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")).collect():
            centroids[r["cluster"]] = [s // r["n"] for s in r["sums"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, dims)
            found = [nearest(x[at : at + step], centroids) for at in range(0, len(x), step)]
            if found:
                own, far = (np.concatenate(f) for f in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(far)], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    given = materialize(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    per = given.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.count("*").alias("cluster_size")).collect()
    inertia = sum(r["cluster_inertia"] for r in per)
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    facts = given.sparkSession.createDataFrame(
        [(r["cluster"], r["cluster_inertia"], inertia, digest(r["cluster"]), r["cluster_size"]) for r in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long",
    )
    return given.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
