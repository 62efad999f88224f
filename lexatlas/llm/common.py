"""Helpers that the training-data operators share: shared-storage writes, distributed prefix sums,
size-checked joins, streamed groups and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

#: Tables of at most so many (narrow) rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset a new local one in local mode (tests),
    an error on a cluster."""
    return shared_folder(spark)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Set the session to hand texts to Python in Arrow batches of at most ``rows`` rows, so that a worker holds few of
    them at once. For programs that own their session (the registered queries, the pipeline); no operator calls it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def new_shared_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them back."""
    path = new_shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized table for broadcast if a count shows at most ``limit`` rows; else leave the join to a
    sort-merge join, whose hot keys adaptive execution splits."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def prefix_sum(df: DataFrame, order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of a long column over a global order, without one task seeing all rows.

    Rows are range-partitioned and sorted, summed within their partition, and materialized; only one total per
    partition goes through the driver to become the partitions' offsets. ``order`` must end in unique columns for
    a unique result.
    """
    spark = df.sparkSession
    schema = df.withColumn(out, F.lit(0).cast("long")).withColumn("_pid", F.lit(0)).schema

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = 0
        for pdf in batches:
            sums = pdf[value].fillna(0).astype("int64").cumsum() + run
            run = int(sums.iloc[-1]) if len(sums) else run
            yield pdf.assign(**{out: sums})[schema.names]

    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    local = materialize(ranged.withColumn("_pid", F.spark_partition_id()).mapInPandas(add, schema))
    totals = dict(local.groupBy("_pid").agg(F.sum(value)).collect())
    before, offsets = 0, []
    for pid in range(max(totals, default=-1) + 1):
        offsets.append(before)
        before += totals.get(pid) or 0
    at = F.lit(0).cast("long") if not offsets else F.element_at(F.array(*map(F.lit, offsets)).cast("array<long>"), F.col("_pid") + 1)
    return local.withColumn(out, F.col(out) + at).drop("_pid")


def stream_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[dict[str, np.ndarray]], pd.DataFrame | None], schema: str) -> DataFrame:
    """Apply ``fn`` to the column arrays of each group of ``keys``. Groups must be of bounded size (split hot ones
    first): rows are hash-partitioned by the keys and sorted, and each task holds one group at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict[str, np.ndarray]] = []
        last = None
        done: list[pd.DataFrame] = []

        def flush() -> None:
            if held:
                out = fn({c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0])
                if out is not None and len(out):
                    done.append(out)
                held.clear()

        for pdf in batches:
            if not len(pdf):
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            change = np.zeros(len(pdf), bool)
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(cols[k][a] for k in keys)
                if key != last:
                    flush()
                    last = key
                held.append({c: v[a:b] for c, v in cols.items()})
            if done:
                yield pd.concat(done, ignore_index=True)
                done.clear()
        flush()
        if done:
            yield pd.concat(done, ignore_index=True)

    return df.repartition(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph of long ids: (u, v) edges in, (node, component) out, component being the
    smallest id reachable; nodes that are their own component's smallest id, and isolated ones, are left out.

    Alternating large-star and small-star steps; each step is a pre-aggregated minimum and a join back, so a node with
    very many edges is split by adaptive skew handling and no component is gathered anywhere. A round is cut off by a
    write into the shared folder.
    """
    a, b = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    cur = materialize(edges.where("u <> v").select(a, b).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    state = mark(cur)
    while state[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct())
        now = mark(cur)
        if now == state:
            break
        state = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
