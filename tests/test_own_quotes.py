"""Quotes of which the true ones are known."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexatlas import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j7_verify_own_quotes", "l8_answer_own_quotes"])
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_every_document_has_a_true_quote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["j7_verify_own_quotes"](spark, SF)
    assert got.where("rule_id = 0 and verbatim").select("doc_id").distinct().count() == docs.count()
    assert got.where("rule_id = 1 and not verbatim").count() > docs.count() // 2
    quotes = queries.QUERIES["l8_answer_own_quotes"](spark, SF)
    assert quotes.where(F.col("evidence_quote").isNotNull()).count() == got.where("verbatim").count()
