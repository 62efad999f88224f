"""Near-duplicate embeddings by an inverted index with product quantisation and exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, small_or_shuffled, stream_groups

#: Rows of each side of a search unit.
UNIT_ROWS = 1024


def _kmeans(x: np.ndarray, k: int, steps: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


class ProductQuantiser:
    """Coarse centres on the sphere and per-subspace codebooks of the residuals, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int, subspaces: int, codes: int):
        c = _kmeans(sample, lists, 8, 1)
        self.centres = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        rest = sample - self.centres[np.argmax(sample @ self.centres.T, axis=1)]
        self.cuts = [np.array(s) for s in np.array_split(np.arange(sample.shape[1]), min(subspaces, sample.shape[1]))]
        self.books = [_kmeans(rest[:, s], codes, 6, 2 + i) for i, s in enumerate(self.cuts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and reconstruction error of unit vectors."""
        own = np.argmax(x @ self.centres.T, axis=1)
        rest = x - self.centres[own]
        codes = np.stack([np.argmin((b**2).sum(1) - 2 * (rest[:, s] @ b.T), axis=1) for s, b in zip(self.cuts, self.books, strict=True)], 1)
        back = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return own, codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def measure(self, sample: np.ndarray, threshold: float, z: float, points: int = 1500, kin: int = 4) -> None:
        """Set ``width``, the part of the exact bound within which neighbours' lists are probed.

        Neighbours at the threshold are made of sample vectors x in the directions that neighbours may lie in: those of the
        nearest sample vectors, those between any two of the sample, and any direction at all. Each needs some width to be
        found from either side; the largest but for 1 in 2000 of each kind of direction counts, times ``z``, at most the
        whole bound, which holds for every direction. So vectors that fill few dimensions are probed further.
        """
        rng = np.random.default_rng(11)
        x = sample[rng.choice(len(sample), min(points, len(sample)), replace=False)]
        near = np.empty((len(x), min(kin, len(sample))), np.int64)
        for at in range(0, len(x), 128):
            near[at : at + 128] = np.argpartition(-(x[at : at + 128] @ sample.T), near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        any_two = lambda: sample[rng.integers(0, len(sample), len(x))]
        kinds = [
            [sample[near[:, i]] for i in range(near.shape[1])], [any_two() - any_two() for _ in range(kin)], [rng.normal(size=x.shape) for _ in range(kin)],
        ]
        tan, widths = np.sqrt(1 - threshold**2) / threshold, [0.0]
        for kind in kinds:
            need = []
            for y in kind:
                u = y - (y * x).sum(1, keepdims=True) * x
                size = np.linalg.norm(u, axis=1)
                fits = size > 1e-6
                v = x[fits]
                w = threshold * v + np.sqrt(1 - threshold**2) * u[fits] / size[fits, None]
                v_near, w_near = v @ self.centres.T, w @ self.centres.T
                o, c, row = v_near.argmax(1), w_near.argmax(1), np.arange(len(v))
                apart = np.linalg.norm(self.centres[o] - self.centres[c], axis=1)
                gap = np.minimum(v_near[row, o] - v_near[row, c], w_near[row, c] - w_near[row, o])
                need.append(np.where(o == c, 0, gap / np.maximum(tan * apart, 1e-12)))
            if len(need := np.concatenate(need)):
                widths.append(float(np.quantile(need, 0.9995)))
        self.width = min(1.0, z * max(widths))

    def probes(self, x: np.ndarray, threshold: float) -> list[np.ndarray]:
        """Lists that may hold a vector of cosine >= threshold to each x.

        A neighbour is cos(a) x + sin(a) u with a unit vector u orthogonal to x; it falls to list c instead of x's own list o
        only if u.(c - o) >= (x.o - x.c) / tan(a). Since u.(c - o) <= |c - o| for every u, lists beyond that need not be
        probed; those beyond ``width`` of it are not.
        """
        near = x @ self.centres.T
        own = near.argmax(1)
        reach = self.width * np.sqrt(1 - threshold**2) / threshold
        apart = np.sqrt(np.maximum(0, 2 - 2 * self.centres @ self.centres.T))
        gap = near[np.arange(len(x)), own][:, None] - near
        return [np.flatnonzero(row) for row in gap <= reach * apart[own] + 1e-12]

    def distances(self, q: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of query vectors to the coded members of a list, by table lookup."""
        rest = q - self.centres[centre]
        total = np.zeros((len(q), len(codes)), np.float32)
        for i, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            table = ((rest[:, s, None] - b.T[None]) ** 2).sum(1).astype(np.float32)
            total += table[:, codes[:, i]]
        return np.sqrt(total)


def _bits(places: np.ndarray, n: int) -> bytes:
    out = np.zeros(n, bool)
    out[places] = True
    return np.packbits(out).tobytes()


def _unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_embeddings(
    vectors: DataFrame, threshold: float = 0.9, max_sample: int = 20_000, lists: int | None = None, subspaces: int = 8, codes: int = 64, z: float = 1.25,
) -> DataFrame:
    """Link the rows of ``vectors`` (vec_id, embedding, ...) whose cosine, in double precision, is >= ``threshold``.

    The index is fitted on at most ``max_sample`` vectors in hash order and holds all: each vector lies in one of
    about sqrt(n) coarse lists as a residual code with its reconstruction error. Each vector searches the lists that a
    neighbour may lie in (a pair is found if either finds the other; how far is measured on the sample, with ``z`` as a
    margin, so that vectors of few inner dimensions lose no links; a ``z`` of 100 gives the bound that holds for all), compares table-lookup distances there, less the member's error, with the threshold's distance
    (which loses no pair of the probed lists), and the rest by exact cosine. Equal embeddings are one class. A list's
    members and searchers are dealt into units of bounded size; units return link counts and a spanning forest, never
    pairs.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (smallest vec_id
    reachable, itself included), kept (vec_id = component_id). Null and zero vectors, those with null or non-finite
    components, and null ids' links: the first three link with nothing; a null vec_id gets component_id of its
    component, or null. Vectors of different length never link. Rows that repeat a vec_id count as rows of their own.
    An empty table gives an empty result; other columns are ignored.
    """
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = materialize(
        vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(good, F.col("embedding")).alias("embedding")).withColumn("key", F.sha2(F.to_json("embedding"), 256))
    )
    lead = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "row"))
    classes = materialize(
        rows.where("embedding is not null").groupBy("key").agg(lead.alias("lead"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
        .select("key", F.col("lead.row").alias("node"), F.col("lead.vec_id").alias("lead_id"), "copies", "embedding")
    )
    found = None
    for (dim,) in classes.select(F.size("embedding")).distinct().collect():
        part = _search(classes.where(F.size("embedding") == dim), threshold, max_sample, lists, subspaces, codes, z)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialize(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    full = classes.drop("embedding").join(links, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    full = materialize(full)
    heads = full.groupBy("component").agg(F.min("lead_id").alias("component_id"))
    full = materialize(full.join(heads, "component").select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("vec_id", "key").join(full, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _search(classes: DataFrame, threshold, max_sample, lists, subspaces, codes, z) -> DataFrame:
    spark = classes.sparkSession
    n, kind = classes.count(), classes.schema["embedding"].dataType.simpleString()
    sample = classes.orderBy(F.xxhash64("key"), "key").limit(max_sample).select("embedding").collect()
    lists = lists or max(1, min(len(sample) // 4, round(n**0.5)))
    unit = _unit(r[0] for r in sample)
    quantiser = ProductQuantiser(unit, lists, subspaces, codes)
    quantiser.measure(unit, threshold, z)
    shared = spark.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pq = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(pdf["embedding"])
            own, code, error = pq.encode(x)
            probes = pq.probes(x, threshold)
            yield pd.DataFrame({"node": pdf["node"], "copies": pdf["copies"], "vector": pdf["embedding"], "list": own.astype(np.int32), "codes": [c.tobytes() for c in code], "error": error, "probes": [p.astype(np.int32) for p in probes], "asks": [_bits(p, len(pq.centres)) for p in probes]})

    coded = materialize(classes.select("node", "copies", "embedding").mapInPandas(encode, f"node long, copies long, vector {kind}, list int, codes binary, error double, probes array<int>, asks binary"))
    blocks = lambda d: d.agg(F.ceil(F.count("*") / UNIT_ROWS).cast("int").alias("blocks"))
    searches = coded.select("node", "copies", "vector", F.col("list").alias("home"), F.explode("probes").alias("list"))
    held, asked = blocks(coded.groupBy("list")).withColumnRenamed("blocks", "held"), blocks(searches.groupBy("list")).withColumnRenamed("blocks", "asked")
    grid = small_or_shuffled(materialize(held.join(asked, "list")))
    at = lambda n: F.expr(f"cast(pmod(xxhash64(node), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    members = coded.join(grid, "list").select("list", at("held").alias("mb"), every("asked").alias("qb"), "node", "copies", "vector", F.col("list").alias("home"), "codes", "error", "asks")
    searchers = searches.join(grid, "list").select("list", every("held").alias("mb"), at("asked").alias("qb"), "node", "copies", "vector", "home", *(F.lit(None).cast(k).alias(c) for c, k in (("codes", "binary"), ("error", "double"), ("asks", "binary"))))
    far = np.sqrt(2 - 2 * threshold) + 1e-5

    def search(g: dict[str, np.ndarray]) -> pd.DataFrame | None:
        pq = shared.value
        is_query = np.isnan(g["error"].astype(float))
        m, q = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        if not len(m) or not len(q):
            return None
        x = _unit(g["vector"])
        code = np.stack([np.frombuffer(bytes(c), np.uint8) for c in g["codes"][m]])
        near = pq.distances(x[q], int(g["list"][0]), code) - g["error"][m].astype(np.float32) <= far
        i, j = np.nonzero(near)
        exact = np.empty(len(i))
        for lo in range(0, len(i), 65536):
            exact[lo : lo + 65536] = np.einsum("ij,ij->i", x[q[i[lo : lo + 65536]]], x[m[j[lo : lo + 65536]]])
        node = g["node"].astype(np.int64)
        ok = (exact >= threshold) & (node[q[i]] != node[m[j]])
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        home = g["home"].astype(np.int64)[q[i]]
        asks = np.stack([np.frombuffer(bytes(c), np.uint8) for c in g["asks"][m]])[j, home >> 3] >> (7 - (home & 7)) & 1
        i, j = q[i], m[j]
        links, copies = np.zeros(len(node), np.int64), g["copies"].astype(np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, np.where(asks, 0, copies[i]))  # a member that does not search the searcher's list counts the link here
        nodes, place = np.unique(node, return_inverse=True)
        root = np.arange(len(nodes))
        while True:
            new = root.copy()
            np.minimum.at(new, place[i], root[place[j]])
            np.minimum.at(new, place[j], root[place[i]])
            if (new == root).all():
                break
            root = new
        hit = np.unique(np.concatenate([i, j]))
        return pd.DataFrame({"node": node[hit], "links": links[hit], "root": nodes[root[place[hit]]]})

    return stream_groups(members.unionByName(searchers), ["list", "mb", "qb"], search, "node long, links long, root long")
