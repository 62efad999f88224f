"""The pipeline and its stages on empty tables, nulls, ties, long texts and columns with the stages' own names."""

import pytest

import corpus_pipeline

from .test_operators import ODD, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, r_id long, text_hash long, kept boolean, n long, doc string, row int, leak string, size long"
LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


def tables(spark, path, rows, labels=(), items=()):
    docs = [(i, t, None, s, None, i, 5, False, 1, "doc", 3, "leak", 9) for i, t, s in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), ITEMS).write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, tmp_path, labelled):
    """Without labels and items nothing is rejected; rows that repeat id and text leave one; null and empty texts stay."""
    import random

    rng = random.Random(3)
    plain = [(100 + i, words(rng, 60), "c") for i in range(30)]
    labels = [(100 + i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, None, None), (1, 0, 0), (1, 1, 1)] if labelled else []
    docs = tables(spark, str(tmp_path), ODD + plain, labels, [(1, None), (2, ""), (None, words(rng, 30))])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    one = corpus_pipeline.ngram_join(spark, docs, str(tmp_path)).collect()
    assert len({(r["doc_id"], r["text"]) for r in one}) == len(one)
    assert {(r["doc_id"], r["text"]) for r in one} >= {(i, t) for i, t, _ in plain} | {(3, "one two"), (4, "x" * 20000), (5, "word " * 30000)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not labelled:
        assert {r["doc_id"] for r in got} >= {100 + i for i in range(30)}


def test_no_documents(spark, tmp_path):
    docs = tables(spark, str(tmp_path), [], [(1, 1, 0)], [(1, "a passage of a benchmark")])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stage_after_stage_keeps_whole_rows(spark, tmp_path):
    """Columns beside doc_id and text come out as they went in, also of rows that repeat."""
    docs = tables(spark, str(tmp_path), [(1, "one two three four five six", "a")] * 3 + [(2, "seven eight nine ten eleven twelve", "b")])
    kept = corpus_pipeline.ngram_join(spark, docs, str(tmp_path))
    assert sorted(kept.collect(), key=lambda r: r["doc_id"]) == sorted(docs.dropDuplicates().collect(), key=lambda r: r["doc_id"])
