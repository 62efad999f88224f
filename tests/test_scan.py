"""Segmented scans equal windows, and a hot key spreads over the tasks."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.functions.scan import bare, carried, numbered, ranges
from lexatlas.operators import history, pages


@pytest.fixture(scope="module")
def rows(spark):
    """Key "hot" has a third of all rows; nulls in keys, times and values; repeats."""
    rng = random.Random(3)
    data = [(i, rng.choice(["hot", "hot", None, *"abcdefghijklm"][: 16 if i % 2 else 2]), rng.choice([None, *range(400)]), rng.choice([None, None, None, "x", "y", "z"])) for i in range(3000)]
    return spark.createDataFrame(data, "row int, k string, t int, v string").repartition(5)


@pytest.mark.parametrize("parts", [1, 2, 13])
def test_equal_to_windows(spark, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        w = W.partitionBy("k").orderBy("t", "row")
        want = rows.withColumns({"n": F.row_number().over(w) - 1, "own": F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "prev": F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, -1))})
        ranged = ranges(rows, ["k"], ["t", "row"])
        got = carried(numbered(ranged, ["k"], ["t", "row"], "n"), ["k"], ["t", "row"], {"own": (F.col("v"), True), "prev": (F.col("v"), False)})
        assert sorted(map(str, bare(got).select(want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_hot_key_spreads(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        per = ranges(rows, ["k"], ["t", "row"]).groupBy("_seg").agg(F.count("*").alias("n"), F.count_if(F.col("k") == "hot").alias("hot")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len([r for r in per if r["hot"]]) >= 6 and max(r["n"] for r in per) < 3 * 3000 / 12


def test_empty(spark, rows):
    none = rows.where("false")
    assert carried(numbered(none, ["k"], ["t"], "n").drop("_at", "_seg"), ["k"], ["t"], {"p": (F.col("v"), False)}).count() == 0


def test_ranked_pages_are_limited_before_the_exchange(spark):
    scans = spark.createDataFrame([(str(i % 3), f"u{i}", i) for i in range(50)], "client_id string, url string, ts int")
    assert "WindowGroupLimit" in history.mru_pages(scans, 3)._jdf.queryExecution().executedPlan().toString()


def test_usable_texts_with_ties_and_nulls(spark):
    good, other = "g" * 30, "h" * 40
    data = [("p", 1, "thin"), ("p", 2, good), ("p", 2, good), ("p", 3, None), ("p", 4, "none here"), ("p", 5, other), ("p", 6, "none here"), (None, 1, good), (None, 2, ""), ("q", 1, None)]
    got = pages.usable_text_filter(spark.createDataFrame(data, "page string, ts int, text string"), ["none here"]).where("page is not null").collect()
    assert sorted(map(tuple, got)) == [("p", 2, good, False), ("p", 2, good, False), ("p", 3, good, True), ("p", 4, good, True), ("p", 5, other, False), ("p", 6, other, True)]
