"""plan_clean_corpus judges texts from beginning to end, and so does its SQL."""

import duckdb
from pyspark.sql import functions as F

from lexatlas import queries
from lexatlas.operators import pages

PROSE = "We keep personal data of visitors for a year and tell everyone who asks us what we know about them. "
LABELS = "Shoes red | Shoes blue | Hats | Coats of wool | "
PRICES = "#12 | 34 = 56 % "


def test_texts_are_judged_whole(spark, tmp_path):
    texts = {
        7: PROSE * 70 + PRICES * 4000,  # prices behind 7,000 characters of prose
        8: LABELS * 150 + PROSE * 400,  # prose behind 7,000 characters of labels
        16: "This one is prose throughout. " + PROSE * 400,
        17: LABELS * 1000,
    }
    rows = [(i, f"https://a.example.com/{i}", f"<html><body><p>{t}</p></body></html>") for i, t in texts.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["plan_clean_corpus"](spark, str(tmp_path))
    assert {r["doc_id"]: r["verdict"] for r in got.collect()} == {7: "not_prose_or_repeated", 8: "prose", 16: "prose", 17: "not_prose_or_repeated"}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES['plan_clean_corpus']})").fetchall()
    assert sorted(map(repr, found)) == sorted(repr(tuple(r)) for r in got.collect())


def test_limit_of_the_score(spark):
    docs = spark.createDataFrame([(1, LABELS * 150 + PROSE * 400), (2, None), (3, "")], "doc_id long, text string")
    scores = lambda **limit: [r["prose_score"] for r in pages.prose_quality(docs, **limit).orderBy("doc_id").collect()]
    assert scores() == scores(limit=6000) and scores()[0] < 0.4 and scores()[1:] == [0, 0]
    assert scores(limit=None)[0] >= 0.55 and scores(limit=None)[1:] == [0, 0]
    short = docs.withColumn("text", F.left("text", F.lit(5000)))
    assert pages.prose_quality(short).collect() == pages.prose_quality(short, limit=None).collect()
