"""Benchmark decontamination by latent semantic retrieval with word-level checks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .text import hashes, plain_words

BITS = 18
#: Least weight of a word: those that every document holds still count, so that tables of copies are searched.
FLOOR = 0.1
LEAK = "item_id long, lcs double, answer double, cosine double"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _starts(n: int, window: int, stride: int) -> np.ndarray:
    """Starts of windows that cover n words; the last one may be short."""
    return np.arange(0, max(1, n - window + stride), stride)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per word bucket, and documents, over the whole corpus. A task sends one count per bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                df[np.unique(hashes(list(set(plain_words(text)))) >> np.uint32(32 - BITS))] += 1
            n += len(pdf)
        at = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": [-1, *at.tolist()], "n": [n, *df[at].tolist()]})

    df = np.zeros(1 << BITS, np.int64)
    found = docs.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = 0
    for bucket, n in found.collect():
        if bucket < 0:
            total = n
        else:
            df[bucket] = n
    return df, total


def benchmark_passages(benchmark: DataFrame, window: int, stride: int) -> DataFrame:
    """(item_id, item_hash, start, buckets) of the windows of each benchmark text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, key, text in zip(pdf["item_id"], pdf["item_hash"], pdf["text"], strict=True):
                b = (hashes(plain_words(text)) >> np.uint32(32 - BITS)).astype(np.int32)
                if len(b):
                    rows += [(item, key, int(s), b[s : s + window]) for s in _starts(len(b), window, stride)]
            yield pd.DataFrame(rows, columns=["item_id", "item_hash", "start", "buckets"])

    items = benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("item_hash"), "text")
    return materialize(items.mapInPandas(cut, "item_id long, item_hash long, start int, buckets array<int>"))


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, iterations: int = 2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, right singular vectors) of the TF-IDF matrix of the passages.

    Range finder with power iterations: each pass computes A'(A Q) task by task over the rows, and a task sends one
    matrix of (distinct buckets x rank), of at most 2^BITS rows whatever its passages; those are added up one at a
    time. Q starts as Gaussian vectors and is orthonormalised on the driver.
    """
    sc = passages.sparkSession.sparkContext
    live = np.array(sorted(r[0] for r in passages.select(F.explode("buckets")).distinct().collect()), int)
    rank = min(rank, len(live))
    at = np.zeros(1 << BITS, np.int32)
    at[live] = np.arange(len(live))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(live), rank)))[0]
    few = passages.select("buckets").coalesce(16)
    for _ in range(iterations + 1):
        shared = sc.broadcast((at, idf, q))

        def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, idf, q = shared.value
            z = np.zeros_like(q)
            for pdf in batches:
                for b in pdf["buckets"]:
                    own = at[b]
                    values = idf[b][:, None]
                    np.add.at(z, own, values * (values * q[own]).sum(0))
            yield pd.DataFrame({"z": [z.astype(np.float32).tobytes()]})

        z = np.zeros_like(q)
        for row in few.mapInPandas(multiply, "z binary").toLocalIterator():
            z += np.frombuffer(bytes(row["z"]), np.float32).reshape(q.shape)
        q, _, _ = np.linalg.svd(z, full_matrices=False)
        shared.unpersist()
    return live, q


def _lcs(hits: list[int], length: int) -> int:
    """Length of the longest common subsequence with an item of 'length' words. hits: for each word of the region that
    the item has, the item's positions of that word as bits."""
    full = (1 << length) - 1
    v = full
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def leak_finders(
    docs: DataFrame, benchmark: DataFrame, rank: int = 200, window: int = 32, stride: int = 16, cosine: float = 0.3,
    share: float = 0.4, lcs: float = 0.6, answer: float = 0.5, block: int = 4000,
) -> Iterator:
    """Pandas UDFs from text to the leaks of one block of the benchmark each: arrays of (item_id, lcs, answer, cosine)."""
    passages = benchmark_passages(benchmark.select("item_id", "text").dropDuplicates(), window, stride)
    n_items = passages.count()
    if not n_items:
        return
    df, total = document_frequencies(docs)
    idf = np.maximum(np.log((1 + total) / (1 + df)), FLOOR).astype(np.float32)
    live, vectors = randomised_svd(passages, idf, rank)
    at = np.full(1 << BITS, len(live), np.int32)
    at[live] = np.arange(len(live))
    vectors = np.vstack([vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)
    n_blocks = -(-n_items // block)
    numbered = materialize(passages.select("item_id", "item_hash").distinct().withColumn("block", F.pmod(F.xxhash64("item_hash"), F.lit(n_blocks))))
    texts = benchmark.select("item_id", "text", F.xxhash64("text").alias("item_hash")).dropDuplicates()
    for i in range(n_blocks):
        own = texts.join(numbered.where(F.col("block") == i).drop("block"), ["item_id", "item_hash"]).select("item_id", "text").collect()
        own.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        if own:
            yield _finder(docs.sparkSession, [(r["item_id"], r["text"]) for r in own], at, idf, vectors, window, stride, cosine, share, lcs, answer)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **search) -> DataFrame:
    """Benchmark items (item_id, text) that documents (doc_id, text, ...) hold, verbatim or paraphrased.

    Every document is cut into windows of words. Windows are TF-IDF vectors (frequencies over the whole corpus) in the
    latent space of a randomised SVD of the benchmark's TF-IDF passages; those with cosine >= ``cosine`` to a passage and
    ``share`` of its length in its direction are candidates, and the words around them are compared with the whole item: a leak has a longest common
    subsequence of at least ``lcs`` of the item's words and of ``answer`` of its answer (the words of its last
    sentence), or at least the mean of ``lcs`` and 1 without the answer. Windows are not projected
    if the benchmark's words in them have less squared weight than ``share`` of the lightest passage. The benchmark is taken in blocks of
    ``block`` passages, each a pass over the documents, so what is broadcast is bounded. Parameters: those of ``leak_finders``.

    Returns one row per document row and item leaked: doc_id, text_hash, item_id, lcs, answer, cosine (the best of its
    windows). Null and wordless texts on either side match nothing; repeated rows and items are reported each by itself
    (items that repeat id and text: once); an empty table on either side gives an empty result; further columns are
    ignored.
    """
    found = None
    for finder in leak_finders(docs, benchmark, **search):
        part = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(finder("text")).alias("leak")).select("doc_id", "text_hash", "leak.*")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], f"doc_id long, text_hash long, {LEAK}")
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **search) -> DataFrame:
    """The rows of ``docs`` without a leak (``find_leaks``), with all their columns; a pass per block of the benchmark,
    each over what the one before has left, and no join."""
    kept = None
    for finder in leak_finders(docs, benchmark, **search):
        kept = (docs if kept is None else materialize(kept)).where(F.size(finder("text")) == 0)
    return docs if kept is None else kept


def _finder(spark, own, at, idf, vectors, window, stride, cosine, share, lcs, answer):
    items, spots, sides, squares = [], [], [], np.inf
    for item, text in own:
        words = hashes(plain_words(text)).tolist()
        last = hashes(plain_words(_SENTENCE.split(text.strip())[-1])).tolist()
        last = last if len(last) >= 3 else words[-8:]
        items.append((item, len(words), _masks(words), len(last), _masks(last)))
        b = np.array(words, np.uint32) >> np.uint32(32 - BITS)
        for s in _starts(len(words), window, stride):
            spots.append((len(items) - 1, int(s)))
            squares = min(squares, float((idf[b[s : s + window]] ** 2).sum()))
            sides.append((idf[b[s : s + window], None] * vectors[at[b[s : s + window]]]).sum(0))
    side = np.stack(sides)
    length = np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-9)
    side = np.hstack([side / length, length])
    shared = spark.sparkContext.broadcast((items, spots, side, at, idf, vectors))

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, spots, side, at, idf, vectors = shared.value
        none, side, full = len(vectors) - 1, side[:, :-1], side[:, -1]
        least = share * squares
        for texts in batches:
            rows = []
            for text in texts:
                leaks: list[dict] = []
                rows.append(leaks)
                h = hashes(plain_words(text))
                if not len(h):
                    continue
                b = h >> np.uint32(32 - BITS)
                spot, weight = at[b], idf[b]
                square = weight * weight
                starts = _starts(len(h), window, stride)
                ends = np.minimum(starts + window, len(h))
                square[spot == none] = 0
                own = np.concatenate([[0], np.cumsum(square, dtype=np.float64)])
                starts = starts[own[ends] - own[starts] >= least]
                if not len(starts):
                    continue
                spot, weight = np.append(spot, np.full(window, none)), np.append(weight, np.zeros(window, np.float32))
                best: dict[int, tuple[float, float, float]] = {}
                tried: dict[int, int] = {}
                words = None
                for lo in range(0, len(starts), 256):
                    grid = starts[lo : lo + 256, None] + np.arange(window)
                    z = (weight[grid][:, None] @ vectors[spot[grid]])[:, 0]
                    held = z @ side.T
                    near = held / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                    for i, j in zip(*np.nonzero((near >= cosine) & (held >= share * full)), strict=True):
                        n, offset = spots[j]
                        item, length, masks, n_last, last = items[n]
                        begin = int(starts[lo + i]) - offset - window
                        if (n in best and best[n][0] == 1.0) or abs(tried.get(n, -(1 << 40)) - begin) <= window // 2:
                            continue  # those words have been compared with this item: a region has a window before it and two behind
                        words = h.tolist() if words is None else words
                        region = words[max(0, begin) : begin + length + 3 * window]
                        tried[n] = begin
                        hits = [m for w in region if (m := masks.get(w))]
                        if len(hits) < lcs * length or (common := _lcs(hits, length) / length) < lcs:
                            continue
                        said = _lcs([m for w in region if (m := last.get(w))], n_last) / n_last
                        if (said >= answer or common >= (1 + lcs) / 2) and (n not in best or common > best[n][0]):
                            best[n] = (common, said, float(near[i, j]))
                leaks += [dict(zip(("item_id", "lcs", "answer", "cosine"), (items[n][0], *v), strict=True)) for n, v in sorted(best.items())]
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(search, f"array<struct<{LEAK.replace(' ', ':')}>>".replace(",:", ","))
