"""Readers and writers of the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import derive_analyses, new_snapshots, snapshot_rows
from ..operators.risk import score_label

PAGE_SCHEMA = "page_id long, url string, status int, content_type string, html string, body binary, fetched_at timestamp"
SCAN_SCHEMA = "scan_id long, client_id string, url string, content_hash string, ts timestamp"
ANALYSIS_SCHEMA = (
    "analysis_id string, client_id string, url string, domain string, title string, safety_score int, safety_prediction string, summary string, "
    "findings array<struct<category string, attention_level string, title string, section string, evidence string, explanation string>>, content_hash string, created_at timestamp"
)


def read_crawl(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """S1. Fetched pages from Parquet, JSON, or raw files ('binaryFile': the path is the url and the content the body).
    Parquet keeps its own columns and merges additive ones."""
    if fmt == "parquet":
        return spark.read.option("mergeSchema", "true").parquet(path)
    if fmt == "json":
        return spark.read.schema(schema or PAGE_SCHEMA).json(path)
    if fmt == "binaryFile":
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return raw.select(F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("content_type"), F.col("content").alias("body"), F.col("modificationTime").alias("fetched_at"))
    raise ValueError(f"unknown format {fmt}")


def spread(df: DataFrame, most_bytes: int = 1 << 30) -> DataFrame:
    """The table dealt over all cores where its files give fewer tasks than there are (a small table in one row group, read
    before heavy text work); a table of more than ``most_bytes`` as it is, so that no large one is shuffled for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= most_bytes else df


def append_analyses(df: DataFrame, path: str, batch: str | None = None) -> None:
    """S4. Append analyses, by day; the label follows from the score where it is missing, the id from the row's key. With
    a name of the ``batch`` a repeated write replaces what the first one left; all batches of a path have one, or none."""
    rows = df.withColumn("safety_prediction", F.coalesce("safety_prediction", score_label(F.coalesce("safety_score", F.lit(0)))))
    rows = rows.withColumn("analysis_id", F.coalesce("analysis_id", F.sha2(F.concat_ws("|", "client_id", "url", "content_hash", F.col("created_at").cast("string")), 256)))
    rows = rows.withColumn("scan_date", F.to_date("created_at"))
    if batch is None:
        rows.write.mode("append").partitionBy("scan_date").parquet(path)
    else:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_date", "batch").parquet(path)


def read_analyses(spark: SparkSession, path: str) -> DataFrame:
    """S6. Stored analyses; filters on scan_date prune partitions."""
    return derive_analyses(spark.read.option("mergeSchema", "true").parquet(path))


def append_snapshots(docs: DataFrame, snapshots: DataFrame, path: str, analyses: DataFrame | None = None) -> None:
    """S5. Append the documents (domain, content_hash, text, created_at) that are new or changed, each version once, as snapshot
    rows with their raw_text and the analysis_json of ``analyses`` (domain, content_hash, ...), by a hash of the domain. A
    batch that was written is not new any more, so it may be repeated once ``snapshots`` holds it."""
    done = docs.select("domain", "content_hash").limit(0) if analyses is None else analyses
    rows = snapshot_rows(new_snapshots(docs, snapshots), done).withColumn("domain_hash", F.pmod(F.xxhash64("domain"), F.lit(64)))
    rows.write.mode("append").partitionBy("domain_hash").parquet(path)


def append_snapshot_table(docs: DataFrame, analyses: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """S5 on a catalog table that is bucketed by domain: appends what is new or changed, and returns the table. The latest
    versions, as-of lookups and the next append read its side without an exchange. Append several versions of a domain
    one after the other: each batch is compared with what is stored, and a repeated batch adds nothing. A table that is made
    with a ``path`` keeps its files there when it is dropped.

    Texts are exchanged once, into the buckets; whether there is anything new is seen by keys alone."""
    spark = docs.sparkSession
    dealt = docs.repartition(buckets, "domain")
    if spark.catalog.tableExists(table):
        stored = spark.table(table)
        if new_snapshots(docs.select("domain", "content_hash"), stored).isEmpty():
            return stored
        fresh = new_snapshots(dealt, stored)
    else:
        fresh = dealt.dropDuplicates(["domain", "content_hash"])
    writer = snapshot_rows(fresh, analyses.repartition(buckets, "domain")).write.format("parquet").bucketBy(buckets, "domain").sortBy("domain", "created_at").mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return spark.table(table)


def scan_stream(spark: SparkSession, path: str, schema: str = SCAN_SCHEMA) -> DataFrame:
    """S7. Scan events as a stream of Parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def history_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """S7. Write a stream batch by batch; a batch that is repeated after a failure replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
