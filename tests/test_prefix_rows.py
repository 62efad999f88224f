"""W6 gets its segments as rows, not as batches of ten thousand texts."""

from lexatlas.operators import consent


def test_segments_come_as_rows(spark):
    """No operator that takes whole Arrow batches; and pages keep their exact numbers beside a null one, which a batch in
    pandas rounds to floats."""
    text = "We use cookies on this page. " * 4
    rows = [(2**53, 0, text, 1.5), (2**53, 1, text, 2.5), (2**53 + 1, 0, text, 3.5), (None, 0, text, 4.5), (2**53 + 1, 1, "Other", None), (2**53 + 1, 2, None, 5.5)]
    df = consent.dedupe_prefix(spark.createDataFrame(rows, "page_id long, pos int, text string, weight double").coalesce(1))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "ArrowEvalPythonUDTF" not in plan
    assert df.columns == ["page_id", "pos", "text", "weight"]
    assert {tuple(r) for r in df.collect()} == {rows[0], rows[2], rows[3], rows[4]}
