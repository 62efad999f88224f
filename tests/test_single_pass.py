"""Texts are searched once, and pages go to Python in small batches."""

import re

from pyspark.sql import functions as F

from lexatlas.functions.text import chars, hits
from lexatlas.operators import pages, risk


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_reach_python_by_rows(spark):
    html = spark.createDataFrame([(1, "u", "<body><p>x</p></body>")], "page_id long, url string, html string")
    for df in (pages.main_text(html), pages.payload_prose(html)):
        assert "BatchEvalPython" in plan(df) and "ArrowEvalPython" not in plan(df)


def test_filters_repeat_no_cleaning(spark):
    html = spark.createDataFrame([(1, "<script>x</script>")], "page_id long, html string")
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for df, mark in ((pages.payload_prose(html), "pageProps"), (pages.prose_gate(docs), r"\p{M}")):
        assert not any(mark in line for line in plan(df).splitlines() if re.match(r"\W*(\*\(\d+\) )?Filter ", line))


def test_counts_of_characters(spark):
    df = spark.createDataFrame([("Aé1 ßу́ x!",), ("",), (None,)], "t string")
    assert [tuple(r) for r in df.select(chars(F.col("t"), r"[\p{L}\p{M}]"), hits(F.col("t"), r"[\p{L}\p{M}]")).collect()] == [(6, 6), (0, 0), (0, 0)]


def test_sentence_ends_behind_digits(spark):
    text = "One. Two! 3. Four… 5。 " + "word " * 60
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pages.prose_quality(docs).columns == ["doc_id", "text", "prose_score"]


def test_openings_of_patterns():
    assert [risk._opening(p) for p in ("No refunds?", "third[- ]party", "AI", "a|b", r"\bx", "share.{0,5}(data|info)", "(a|b)c", "ab{2}", "IP+")] == [
        "no refund", "third", "ai", "", "", "share", "", "a", "ip",
    ]


def test_guarded_rules_match_as_before(spark):
    docs = spark.createDataFrame([(1, "THIRD-party and Refund; sharing data"), (2, None), (3, "a b")], "doc_id long, text string")
    rules = [("A", "LOW", "t", ["third[- ]party"], ""), ("A", "LOW", "u", ["no refunds?", "refunds?"], ""), ("A", "LOW", "v", ["x|shar.{0,9}data"], "")]
    assert [tuple(r["matches"]) for r in risk.rule_matches(docs, rules).orderBy("doc_id").collect()] == [("THIRD-party", "Refund", "sharing data"), (None,) * 3, (None,) * 3]


def test_leaves_are_large_enough_for_hot_keys():
    """A hot key's parts grow with its rows over a chunk, times its rows over a leaf."""
    from lexatlas.streaming import ordered

    n = 3_600_000
    assert n / ordered.CHUNK * n / (ordered.LEAF_ROWS / 2) < 20_000


def test_snapshot_files_outlive_their_table(spark, tmp_path):
    from lexatlas.sources import crawl

    docs = spark.createDataFrame([("a", "h1", "x", 1), ("a", "h1", "x", 1), ("b", "h2", "y", 2)], "domain string, content_hash string, text string, created_at long")
    none = docs.select("domain", "content_hash").limit(0)
    for _ in range(2):
        crawl.append_snapshot_table(docs, none, "kept_files", 2, f"{tmp_path}/t")
    files = sorted(p.name for p in (tmp_path / "t").glob("*.parquet"))
    spark.sql("DROP TABLE kept_files")
    assert files == sorted(p.name for p in (tmp_path / "t").glob("*.parquet"))
    assert sorted(r["domain"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == ["a", "b"]
