"""Audit of how filters interact: what each removes in every order of application."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_or_shuffled

WORD = r"[^\x20\x09-\x0D]+"
#: Parts whose rows are made at once.
PARTS = 64
REPORT = (
    "part string, filter_order string, step int, filter string, documents long, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def standard_filters() -> dict[str, Column]:
    """The failure conditions A to D on columns text, words and distinct_words; E (a repeated text) is added by the audit."""
    return {
        "A": F.col("words") < 200,
        "B": 100 * F.col("distinct_words") < 50 * F.col("words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 2 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }


def prefix_intervals(n: int) -> list[tuple[tuple[int, ...], int, int]]:
    """(prefix, start, end) for each sequence of distinct filters out of ``n``: the orders that begin with it have the
    lexicographic ranks from start to end - 1. The start is the prefix's Lehmer code: each place's rank among the filters
    not yet used, times the number of orders of those behind it."""
    found = []
    for k in range(1, n + 1):
        for prefix in permutations(range(n), k):
            start = sum(sum(1 for f in range(x) if f not in prefix[:i]) * factorial(n - 1 - i) for i, x in enumerate(prefix))
            found.append((prefix, start, start + factorial(n - k)))
    return found


class RankTable:
    """For each mask of failed filters, the intervals of ranks in which a step removes it or finds it removed earlier."""

    def __init__(self, n: int):
        self.n, self.orders = n, list(permutations(range(n)))
        removed, redundant = [], []
        for prefix, start, end in prefix_intervals(n):
            own, before = 1 << prefix[-1], sum(1 << f for f in prefix[:-1])
            for mask in range(1 << n):
                if mask & own:
                    (redundant if mask & before else removed).append((len(prefix) - 1, start, end, mask))
        self.removed, self.redundant = np.array(removed), np.array(redundant).reshape(-1, 4)

    def steps(self, counts: np.ndarray, intervals: np.ndarray) -> np.ndarray:
        """Documents per (part, rank, step) from documents per (part, mask): each count is added where an interval begins
        and taken off where it ends, and the differences are summed up along the ranks."""
        ends = np.zeros((len(self.orders) + 1, self.n, len(counts)), np.int64)
        step, start, end, mask = intervals.T
        np.add.at(ends, (start, step), counts.T[mask])
        np.subtract.at(ends, (end, step), counts.T[mask])
        return ends.cumsum(axis=0)[:-1].transpose(2, 0, 1)

    def report(self, names: str, parts: list[str], masks: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
        removed, redundant = self.steps(masks, self.removed), self.steps(masks, self.redundant)
        order = np.array(self.orders)
        total = masks.sum(1)
        shapley = np.stack([removed[:, order == f].sum(1) for f in range(self.n)], 1)
        unique = masks[:, [1 << f for f in range(self.n)]]
        p, ranks = len(parts), len(order)
        return pd.DataFrame({
            "part": np.repeat(np.array(parts, object), ranks * self.n),
            "filter_order": np.tile(np.repeat(np.array(["".join(names[f] for f in o) for o in self.orders], object), self.n), p),
            "step": np.tile(np.arange(1, self.n + 1, dtype=np.int32), p * ranks),
            "filter": np.tile(np.array(list(names), object)[order].ravel(), p),
            "documents": np.repeat(total, ranks * self.n),
            "kept": (total[:, None, None] - removed.cumsum(2)).ravel(), "removed": removed.ravel(), "redundant": redundant.ravel(),
            "unique_fails": unique[:, order].ravel(),
            "good_lost": self.steps(good, self.removed).ravel(), "toxic_lost": self.steps(toxic, self.removed).ravel(),
            "shapley": shapley[:, order].ravel(),
        })


def failed_filters(docs: DataFrame, filters: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc_id, part, mask) per document of ``docs`` (doc_id, text, source, ...): bit i of the mask is set if the i-th filter
    fails it; the last filter is the repeated text. Texts are read once and never shuffled: what meets are digests, and
    of those only the ones that several rows have."""
    filters = standard_filters() if filters is None else filters
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text")).withColumn("found", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("doc_id", "part", "text", F.size("found").alias("words"), F.size(F.array_distinct("found")).alias("distinct_words"))
    bits = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(filters.values())), F.lit(0))
    flagged = materialize(rows.select("doc_id", "part", bits.alias("bits"), F.sha2("text", 256).alias("digest")))
    first = flagged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    first = small_or_shuffled(materialize(first.select(F.col("digest").alias("of"), "first_id")))
    repeated = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    both = flagged.join(first, F.col("digest") == F.col("of"), "left")
    return both.select("doc_id", "part", (F.col("bits") + F.when(repeated, 1 << len(filters)).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, repeated: str = "E") -> DataFrame:
    """Audit five (or so) filters over ``docs`` (doc_id, text, source, ...) in all their orders, by source.

    Documents become masks of the filters that fail them, and masks are counted by source, with the ``labels`` (doc_id,
    quality, toxic). For a mask, the orders in which step k removes it are those that begin with some k - 1 filters that
    pass and one that fails: intervals of lexicographic ranks. A part's counts are added at the interval ends and summed
    up along the ranks, so no document is looked at per order.

    ``filters`` names a failure condition on text, words (count) and distinct_words by a letter; ``repeated`` names the
    last filter, which fails documents whose text some smaller doc_id has. Returns per part, order and step (REPORT): the
    step's filter; documents of the part; kept after the step; removed by it; redundant (failed, but removed earlier);
    unique_fails (failed by this filter only); good_lost and toxic_lost (removed with such a label); shapley (removed by
    the filter, summed over all orders).

    A null text is an empty one, and equal to it. A null source is the part "". A null doc_id has no smaller one and no
    labels; rows that repeat a doc_id and text do not fail ``repeated`` by each other; each row counts. A document with
    several labels is good (toxic) if one says so. Conditions that are null do not fail. An empty table has no parts.
    Other columns are ignored.
    """
    filters = standard_filters() if filters is None else filters
    names = "".join(filters) + repeated
    n = len(names)
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    marks = small_or_shuffled(materialize(marks.where("good or toxic")))
    masks = failed_filters(docs, filters).join(marks, F.col("doc_id") == F.col("marked"), "left")
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    of = lambda c, m: F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0))
    per_part = counts.groupBy("part").agg(*(F.array(*(of(c, m) for m in range(1 << n))).alias(c) for c in ("n", "good", "toxic")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = RankTable(n)
        for pdf in batches:
            for at in range(0, len(pdf), PARTS):
                some = pdf.iloc[at : at + PARTS]
                yield table.report(names, some["part"].tolist(), *(np.stack(some[c].tolist()) for c in ("n", "good", "toxic")))

    return per_part.mapInPandas(run, REPORT)
