"""The corpus pipeline on planted rows, stage by stage against plain recomputation."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_operators import near_pairs, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, rows, labels = random.Random(11), [], []
    items = [(i, words(rng, 30) + ". " + words(rng, 8) + ".") for i in range(12)]
    for i in range(420):
        kind = ["good", "good", "good", "junk", "toxic", "copy", "near", "leak"][i % 8]
        text = words(rng, 70)
        if kind == "junk":
            text = " ".join(w + "###" for w in text.split())
        elif kind == "toxic":
            text += " you " + rng.choice(["idiot", "scum", "moron trash"])
        elif kind == "copy":
            text = rows[i - 5][1]
        elif kind == "near":
            old = rows[i - 5][1].split()
            old[5] = "changed"
            text = " ".join(old)
        elif kind == "leak":
            text = words(rng, 30) + " " + items[i % 12][1] + " " + words(rng, 30)
        rows.append((i, text, "en", f"src{i % 3}", len(text), kind))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string").drop("kind").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[: 7 * len(labels) // 10], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r for r in rows}


def test_stages(spark, corpus):
    path, rows = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    kinds = lambda df: {rows[r["doc_id"]][5] for r in df.select("doc_id").collect()}
    count = lambda df, kind: sum(rows[r["doc_id"]][5] == kind for r in df.select("doc_id").collect())
    clean = corpus_pipeline.toxicity(spark, docs, path)
    assert "toxic" not in kinds(clean) and clean.count() >= 360 and clean.columns == names
    good = corpus_pipeline.quality_classifier(spark, clean, path)
    assert count(good, "junk") <= 2 and count(good, "good") >= 155 and good.columns == names
    left = [(r["doc_id"], r["text"], None) for r in good.orderBy("doc_id").collect()]
    gone = {left[max(i, j)][0] for i, j in near_pairs(left)}
    one = corpus_pipeline.ngram_join(spark, good, path)
    assert {r["doc_id"] for r in one.collect()} == {i for i, _, _ in left} - gone and one.columns == names
    fair = corpus_pipeline.decontamination(spark, one, path)
    assert {r["doc_id"] for r in fair.collect()} == {r["doc_id"] for r in one.collect() if rows[r["doc_id"]][5] != "leak"}
    mixed = corpus_pipeline.mixing(spark, fair, path)
    assert mixed.count() == fair.count() and mixed.agg(F.sum("taken")).first()[0] > 0


def test_repeated_rows_leave_one(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 8")
    assert corpus_pipeline.ngram_join(spark, docs.unionByName(docs), path).count() == corpus_pipeline.ngram_join(spark, docs, path).count()


def test_run(spark, corpus):
    path, rows = corpus
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    got = corpus_pipeline.run(spark, path).collect()
    assert 100 <= len(got) <= 220 and {rows[r["doc_id"]][5] for r in got} <= {"good", "copy", "near", "junk"}
