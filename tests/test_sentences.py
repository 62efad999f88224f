"""Cutting texts into sentences."""

from pyspark.sql import functions as F

from lexatlas.functions.text import sentences
from lexatlas.operators import history


def test_sentences_keep_digits_that_equal_their_place(spark):
    df = spark.createDataFrame([("0 none. 1 one 1.\n 22 two 2! 33.1.2.3",)], "text string")
    assert df.select(sentences(F.col("text"))).first()[0] == ["0 none.", "1 one 1.", "22 two 2!", "33.1.2.3"]


def test_changes_name_whole_sentences(spark):
    old = spark.createDataFrame([("k", "A. 11 b")], "key string, text string")
    new = spark.createDataFrame([("k", "A.  11 c")], "key string, text string")
    assert {(r["type"], r["sentence"]) for r in history.sentence_changes(old, new).collect()} == {("removed", "11 b"), ("added", "11 c")}
