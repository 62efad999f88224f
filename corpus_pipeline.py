"""The corpus pipeline: toxicity, quality, near duplicates, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage's result is written as Parquet into the
shared folder and reread as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexatlas.llm.common import bound_batches, materialize, small_or_shuffled
from lexatlas.llm.decontaminate import drop_leaks
from lexatlas.llm.mixing import mix_sources
from lexatlas.llm.near_join import jaccard_links
from lexatlas.llm.quality import keep_quality
from lexatlas.llm.toxicity import keep_harmless


def _same() -> Column:
    """A row of the documents d is one of the keys k (doc_id, text_hash), whatever further columns the documents have."""
    return F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_hash"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of docs that have no row in rejected (doc_id, text_hash). The rejected keys are narrow and materialized;
    they are broadcast while they are few, else joined by shuffle."""
    keys = small_or_shuffled(materialize(rejected.select("doc_id", "text_hash").distinct()))
    return docs.alias("d").join(keys.alias("k"), _same(), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    return keep_harmless(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, and one row of it."""
    keys = jaccard_links(docs).groupBy("doc_id", "text_hash").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    keys = materialize(keys.where("not kept or n > 1"))
    kept = _without(docs, keys.where("not kept"))
    repeated = keys.where("kept")
    if repeated.isEmpty():
        return kept
    once = kept.alias("d").join(small_or_shuffled(repeated.select("doc_id", "text_hash")).alias("k"), _same()).select("d.*")
    return _without(kept, repeated).unionByName(once.dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    return mix_sources(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Classifiers and sampling keys are not SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
