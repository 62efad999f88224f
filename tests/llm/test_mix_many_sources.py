"""Mixing with as many sources as documents, against a sort of all words; and the words that the cut sorts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexatlas.llm import mixing


def brute(rows, budget):
    """rows: (row, rank, end, size, target); the first words by (k / target, rank)."""
    words = sorted((k / target, rank, row) for row, rank, end, size, target in rows for k in range(end - size + 1, end + 1))
    return Counter(row for _, _, row in words[:budget])


@pytest.mark.parametrize("equal", [True, False])
def test_cut_of_many_sources(spark, monkeypatch, equal):
    monkeypatch.setattr(mixing, "FEW", 50)
    rng = np.random.default_rng(6)
    sizes = [7] * 300 if equal else rng.integers(1, 40, 300).tolist()
    targets = [10.0 if equal else float(rng.integers(1, 30)) + rng.random() for _ in sizes]
    rows = [(2 * i + p, i + 1, (p + 1) * n, n, t) for i, (n, t) in enumerate(zip(sizes, targets, strict=True)) for p in (0, 1)]
    budget = sum(sizes) * 3 // 2
    entries = spark.createDataFrame(rows, "row long, rank long, end long, size long, target double").withColumn("tie", F.lit(0))
    sources = spark.createDataFrame([(t, 2 * n) for n, t in zip(sizes, targets, strict=True)], "target double, most long")
    taken, _ = mixing.cut_queue(entries, sources, budget)
    assert {r["row"]: r["n"] for r in taken.groupBy("row").agg(F.sum("words").alias("n")).collect()} == dict(brute(rows, budget))
    before, until = mixing.cut_time(sources, budget)
    sent = lambda at: sum(min(sum(k / t <= at for k in range(1, 2 * n + 1)), 2 * n) for n, t in zip(sizes, targets, strict=True))
    assert sent(before) < budget <= sent(until) and sent(until) - sent(before) <= max(300, 50)


def test_source_per_document(spark):
    rows = [(i, "w " * (i % 17), f"s{i:04d}") for i in range(400)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = sum(r["size"] for r in out)
    assert sum(r["taken"] for r in out) == total * 3 // 2 and all(r["taken"] <= 2 * r["size"] for r in out)
    assert all(abs(r["taken"] - r["target"]) <= 2 for r in out)


def test_words_until_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(float(t), int(k)) for t, k in zip(rng.random(500) * 1e6 + 1e-3, rng.integers(1, 10**6, 500), strict=True)]
    df = spark.createDataFrame(rows, "target double, k long")
    for at in (0.37, 1 / 3, 0.1 + 0.2):
        for r in df.select("target", mixing.words_until(at, F.col("target")).alias("n")).collect():
            assert r["n"] / r["target"] <= at < (r["n"] + 1) / r["target"]
