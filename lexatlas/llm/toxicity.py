"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .text import hashes, plain_words

BITS = 18


def _features(text: str | None) -> np.ndarray:
    """Hashes of the distinct words of the whole text and of their beginnings of 5 to 8 bytes."""
    words = set(plain_words(text))
    parts = [list(words), *(list({w[:n] for w in words if len(w) > n}) for n in (5, 6, 7, 8))]
    return np.concatenate([((hashes(p) ^ np.uint32(i * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS) for i, p in enumerate(parts)]).astype(np.int32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(cols: np.ndarray, lens: np.ndarray, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, keep: int = 1024, l1: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse logistic regression (accelerated proximal gradient) on the ``keep`` features of highest chi-square.
    Returns word weights, weights of the earlier categories, and the intercept."""
    w_full, n = np.zeros(1 << BITS), len(y)
    base = float((weight * y).sum() / max(weight.sum(), 1e-12))
    if n == 0 or base in (0.0, 1.0):
        return w_full, np.zeros(extra.shape[1]), 40.0 if n and base else -40.0
    rows = np.repeat(np.arange(n, dtype=np.int32), lens)
    seen = np.bincount(cols, weight[rows], 1 << BITS)
    hit = np.bincount(cols, (weight * y)[rows], 1 << BITS)
    expected = seen * base
    chi = np.where(np.bincount(cols, minlength=1 << BITS) > 1, (hit - expected) ** 2 / np.maximum(expected * (1 - base), 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:keep])
    at = np.full(1 << BITS, -1)
    at[chosen] = np.arange(len(chosen))
    own = at[cols] >= 0
    r, c, k = rows[own], at[cols[own]], len(chosen)
    x = lambda w: np.bincount(r, w[:k][c], n) + extra @ w[k:-1] + w[-1]
    size = np.bincount(r, minlength=n) + extra.sum(1) + 1
    share = weight / weight.sum()
    curve = 0.25 * np.concatenate([np.bincount(c, (share * size)[r], k), (share * size) @ extra, [float(share @ size)]]) + 1e-6
    w = z = np.concatenate([np.zeros(k + extra.shape[1]), [np.log(base / (1 - base))]])
    t = 1.0
    for _ in range(steps):
        g = share * (_sigmoid(x(z)) - y)
        step = z - np.concatenate([np.bincount(c, g[r], k), g @ extra, [g.sum()]]) / curve
        new = np.sign(step) * np.maximum(np.abs(step) - l1 / curve, 0)
        new[-1] = step[-1]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, z, t = new, new + (t - 1) / t2 * (new - w), t2
    w_full[chosen] = w[:k]
    return w_full, w[k:-1], float(w[-1])


def toxic_kinds(cols: np.ndarray, lens: np.ndarray, y: np.ndarray, kinds: int, keep: int = 512, rounds: int = 20) -> np.ndarray:
    """Kind of each row, 0 for those that are not toxic: spherical k-means of the toxic rows on the ``keep`` features
    that most favour them (each weighed by its log odds), from seeds as far apart as can be. The labels name no
    categories; these are what the toxic texts themselves fall into, the largest first."""
    kind, rows = np.zeros(len(y), int), np.repeat(np.arange(len(y)), lens)
    toxic = np.flatnonzero(y > 0)
    if not len(toxic):
        return kind
    hit, seen = np.bincount(cols[y[rows] > 0], minlength=1 << BITS), np.bincount(cols, minlength=1 << BITS)
    odds = np.log((hit + 0.5) / (len(toxic) + 1)) - np.log((seen - hit + 0.5) / (len(y) - len(toxic) + 1))
    chosen = np.argsort(-(hit * np.maximum(odds, 0)), kind="stable")[:keep]
    at, place = np.full(1 << BITS, -1), np.full(len(y), -1)
    at[chosen], place[toxic] = np.arange(len(chosen)), np.arange(len(toxic))
    own = (at[cols] >= 0) & (place[rows] >= 0)
    x = np.zeros((len(toxic), keep))
    x[place[rows[own]], at[cols[own]]] = np.maximum(odds[cols[own]], 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(kinds, len(toxic)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    centres = x[seeds]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[near == i].mean(0) if (near == i).any() else centres[i] for i in range(len(seeds))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    rank = np.argsort(np.argsort(-np.bincount(near, minlength=len(seeds)), kind="stable"), kind="stable")
    kind[toxic] = rank[near] + 1
    return kind


def fit_chain(docs: DataFrame, labels: DataFrame, kinds: int = 3, max_rows: int = 5000, folds: int = 3) -> list[tuple[str, np.ndarray, np.ndarray, float]]:
    """Fit the links of the chain on at most ``max_rows`` labelled rows, half of each class at most, weighted back to
    the classes' shares. Each link but the last, one per kind of toxic text (``toxic_kinds``), predicts the rows of each fold by a model of the other folds, and
    those out-of-fold probabilities are inputs of the later links; the last link is the toxic label itself. Of rows that repeat a doc_id
    the one with the least hash is taken, so what comes to the driver is bounded."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = materialize(marked.select("doc_id", F.expr("toxic <> 0").cast("int").alias("toxic")))
    total = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    halves = [marked.where(F.col("toxic") == y).orderBy(*order).limit(max_rows // 2) for y in (0, 1)]
    sample = materialize(halves[0].unionByName(halves[1]))

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "cols": [np.unique(_features(t)).tobytes() for t in pdf["text"]]})

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    joined = joined.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = joined.mapInPandas(featurize, "doc_id long, toxic int, cols binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.array([total[r["toxic"]] for r in rows], float)
    for v in (0, 1):
        weight[y == v] /= max(1, int((y == v).sum()))
    lens = np.array([len(r["cols"]) // 4 for r in rows], int)
    cols = np.frombuffer(b"".join(bytes(r["cols"]) for r in rows), np.int32)
    often = (np.bincount(cols, minlength=1 << BITS) >= 3)[cols]  # features of one or two rows teach nothing
    at_row = np.repeat(np.arange(len(rows), dtype=np.int32), lens)[often]
    cols, lens = cols[often], np.bincount(at_row, minlength=len(rows))
    fold, kind = np.arange(len(rows)) % folds, toxic_kinds(cols, lens, y, kinds)
    extra, chain = np.zeros((len(rows), 0)), []
    for i in range(1, kinds + 1):
        target = (kind == i).astype(float)
        chain.append((f"kind{i}", *_fit(cols, lens, extra, target, weight)))
        held = np.zeros(len(rows))
        for f in range(folds):
            own = fold != f
            w, e, b = _fit(cols[own[at_row]], lens[own], extra[own], target[own], weight[own])
            held[~own] = _sigmoid(np.bincount(at_row, w[cols], len(rows)) + extra @ e + b)[~own]
        extra = np.column_stack([extra, held])
    chain.append(("toxic", *_fit(cols, lens, extra, y, weight)))
    return chain


def toxicity_scorer(docs: DataFrame, labels: DataFrame, kinds: int = 3, max_rows: int = 5000):
    """(names of the links, a Pandas UDF from text to an array of their probabilities) of a chain fitted on ``labels``."""
    chain = fit_chain(docs, labels, kinds, max_rows)
    table = np.stack([c[1] for c in chain], 1)
    extras, biases = [c[2] for c in chain], [c[3] for c in chain]
    live = np.flatnonzero(np.abs(table).sum(1))
    small, at = np.vstack([np.zeros(len(chain)), table[live]]), np.zeros(1 << BITS, np.int32)
    at[live] = np.arange(1, len(live) + 1)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        z = np.zeros((len(texts), len(biases)))
        for i, text in enumerate(texts):
            found = at[_features(text)]
            found = found[found > 0]
            if len(found):
                z[i] = small[np.unique(found)].sum(0)
        p = np.zeros_like(z)
        for j in range(len(biases)):
            p[:, j] = _sigmoid(z[:, j] + p[:, :j] @ extras[j] + biases[j])
        return pd.Series(list(p))

    return [c[0] for c in chain], score


def score_toxicity(docs: DataFrame, labels: DataFrame, kinds: int = 3, max_rows: int = 5000, threshold: float = 0.3) -> DataFrame:
    """Score every document of ``docs`` (doc_id, text, ...) by a classifier chain fitted on ``labels`` (doc_id, toxic).

    Returns one row per input row: doc_id, text_hash (xxhash64 of the text), p_kind1 and so on of the ``kinds`` of toxic text, p_toxic and
    toxic (p_toxic >= threshold). Null and empty texts have no words and get the intercepts; labels that are null or
    that no document has are left out, and a doc_id labelled twice is toxic if any label is; without labelled rows, or
    with labels of one class only, every row gets that class's (or no) toxicity. Other columns are ignored.
    """
    names, score = toxicity_scorer(docs, labels, kinds, max_rows)
    scored = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), score("text").alias("p"))
    return scored.select("doc_id", "text_hash", *(F.col("p")[j].alias(f"p_{c}") for j, c in enumerate(names)), (F.col("p")[len(names) - 1] >= threshold).alias("toxic"))


def keep_harmless(docs: DataFrame, labels: DataFrame, kinds: int = 3, max_rows: int = 5000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``score_toxicity`` does not call toxic, with all their columns, in one pass."""
    names, score = toxicity_scorer(docs, labels, kinds, max_rows)
    return docs.where(score("text")[len(names) - 1] < threshold)
