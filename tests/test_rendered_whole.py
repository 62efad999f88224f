"""The choice of a page's text sees whole texts."""

import duckdb
import pytest

from lexatlas import queries
from lexatlas.operators import pages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["p6_rendered_text_choice", "p6_rendered_text_whole"])
def test_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_whole_texts_are_chosen(spark):
    got = {r["page_id"]: (r["text"], r["chosen"]) for r in queries.QUERIES["p6_rendered_text_whole"](spark, SF).collect()}
    texts = {r["page_id"]: r["text"] for r in pages.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert len(got) == 2 * len(texts)
    assert all(got[2 * i] == (t, "static") for i, t in texts.items() if len(t) >= 200) and any(len(t) >= 200 for t in texts.values())
    assert {c for _, c in got.values()} == {"static", "payload", "rendered"}
