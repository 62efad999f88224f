"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sum, small_or_shuffled
from .text import hashes, ngrams, runs


def _buckets(text: str | None, bits: int) -> np.ndarray:
    """Bucket of each unigram and bigram of the whole text."""
    h = hashes(runs(text))
    one = (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    return np.concatenate([one, ngrams(h, 2) >> np.uint64(64 - bits)]).astype(np.int64)


def fit_ratio(docs: DataFrame, sample: DataFrame, bits: int, smooth: float) -> np.ndarray:
    """log(target / raw) of each bucket. The raw model counts all documents; the target model those of ``sample``
    (a bounded table of doc_id) alone. Each task sends a count per bucket and model, whatever its rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, 1 << bits), np.int64)
        for pdf in batches:
            for text, good in zip(pdf["text"], pdf["good"], strict=True):
                own = np.bincount(_buckets(text, bits), minlength=0)
                sums[0, : len(own)] += own
                if good:
                    sums[1, : len(own)] += own
        at = np.flatnonzero(sums[0])
        yield pd.DataFrame({"bucket": at, "raw": sums[0, at], "target": sums[1, at]})

    flagged = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left")
    flagged = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good"))
    found = flagged.mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    counts = np.full((2, 1 << bits), float(smooth))
    for bucket, raw, target in found:
        counts[:, bucket] += raw, target
    p = np.log(counts / counts.sum(1, keepdims=True))
    return p[1] - p[0] if any(r[2] for r in found) else np.zeros(1 << bits)


def calibrate(x: np.ndarray, good: np.ndarray, good_weight: float) -> tuple[float, float]:
    """Slope and intercept of a logistic curve from scores to being good, a good row counting as ``good_weight`` bad
    ones, fitted to targets drawn in by one row of each kind, so that separate kinds give finite odds."""
    w = np.where(good, good_weight, 1.0)
    yes, no = float((w * good).sum()), float((w * ~good).sum())
    target = np.where(good, (yes + 1) / (yes + 2), 1 / (no + 2))
    rows, line = np.stack([np.clip(x, -20, 20), np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -40, 40)))
        line = line - np.linalg.solve((rows * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + 1e-6 * np.eye(2), rows.T @ (w * (p - target)))
    return float(line[0]), float(line[1])


def quality_scorer(docs: DataFrame, labels: DataFrame, bits: int = 16, smooth: float = 1.0, max_rows: int = 20_000, good_weight: float = 10.0):
    """A Pandas UDF from text to log weight, or None without labelled rows of both kinds.

    The target model is fitted on at most ``max_rows`` labelled good rows, every second one of them in hash order; the
    others, and as many labelled bad rows, calibrate: the sum of log(target / raw) over a text's n-grams, over the root of their number
    (a sum of chances grows by the root), becomes the log odds of being good. A doc_id of several rows calibrates by their mean.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [marked.where("quality > 0" if good else "quality <= 0").orderBy(*order).limit(max_rows) for good in (True, False)]
    sample = materialize(parts[0].unionByName(parts[1]).withColumn("fit", F.expr("quality > 0 and pmod(xxhash64(doc_id, 1), 2) = 0")))
    ratio = fit_ratio(docs, sample.where("fit"), bits, smooth)

    def scorer(slope: float, shift: float):
        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            found = [_buckets(t, bits) for t in texts]
            return pd.Series([slope * float(ratio[b].sum()) / (len(b) + 1) ** 0.5 + shift for b in found], dtype=float)

        return score

    held = docs.select("doc_id", "text").join(F.broadcast(sample.where("not fit")), "doc_id")
    held = held.select("doc_id", "quality", scorer(1.0, 0.0)("text").alias("x")).groupBy("doc_id", "quality").agg(F.avg("x").alias("x")).collect()
    held.sort()
    good = np.array([r["quality"] > 0 for r in held], bool)
    if not good.any() or good.all():
        return None
    return scorer(*calibrate(np.array([r["x"] for r in held]), good, good_weight))


def _sampled(docs: DataFrame, labels: DataFrame, seed: int, carry: bool, **fit) -> DataFrame:
    """(doc, doc_id, text_hash, log_weight, gumbel_key, kept); doc is the whole row if ``carry``."""
    score = quality_scorer(docs, labels, **fit)
    weight = F.lit(float("inf")) if score is None else score("text")
    whole = [F.struct("*").alias("doc")] if carry else []
    scored = materialize(docs.select(*whole, "doc_id", F.xxhash64("text").alias("text_hash"), weight.alias("log_weight"), F.monotonically_increasing_id().alias("row")))
    if score is None:
        return scored.withColumn("gumbel_key", F.col("log_weight")).withColumn("kept", F.lit(True))
    again = materialize(scored.groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("a_id"), F.col("text_hash").alias("a_hash"), F.lit(True).alias("again")))
    salt = F.lit(0).cast("long")
    if not again.isEmpty():
        scored = scored.join(small_or_shuffled(again), F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash")), "left")
        salt = F.when(F.col("again"), F.col("row")).otherwise(salt)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", salt, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    share = F.round(1e6 / (1 + F.exp(-F.col("log_weight")))).cast("long")
    k = round((scored.agg(F.sum(share)).first()[0] or 0) / 1e6)
    places = prefix_sum(keyed.select("gumbel_key", F.lit(1).cast("long").alias("one")), [F.col("gumbel_key").desc()], "one", "place")
    last = places.where(F.col("place") <= k).agg(F.min("gumbel_key")).first()[0]
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(float("inf") if last is None else last))


def select_quality(docs: DataFrame, labels: DataFrame, seed: int = 7, **fit) -> DataFrame:
    """Importance resampling of ``docs`` (doc_id, text, ...) towards the rows that ``labels`` (doc_id, quality) calls good.

    A document's log weight is its log odds of coming from the target, by the ratio of two generative models of hashed
    unigrams and bigrams (``quality_scorer``). k is the expected number of target documents, the sum of all
    documents' probabilities; the k documents with the largest log weight plus Gumbel noise are kept, which is a sample
    without replacement in proportion to the weights. The noise is a hash of doc_id, text and ``seed`` (and of the
    row's place, where rows repeat both), so documents near the border are drawn and the others mostly follow their
    weights. The k-th key is found by a range sort and a distributed count.

    Returns one row per input row: doc_id, text_hash, log_weight, gumbel_key, kept. Null and empty texts have the weight of a text
    without n-grams; rows of a key equal to the k-th are all kept; repeated rows are drawn one by one; without labels of both
    kinds all are kept, at infinite weight; an empty table gives an empty result. Other columns are ignored.
    """
    return _sampled(docs, labels, seed, False, **fit).select("doc_id", "text_hash", "log_weight", "gumbel_key", "kept")


def keep_quality(docs: DataFrame, labels: DataFrame, seed: int = 7, **fit) -> DataFrame:
    """The rows of ``docs`` that ``select_quality`` keeps, with all their columns and without a join on texts."""
    return _sampled(docs, labels, seed, True, **fit).where("kept").select("doc.*")
