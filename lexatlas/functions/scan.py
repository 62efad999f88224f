"""Ordered scans of keyed rows that do not gather a key: ranges of (key, order) with a carried border state."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import written

#: A row's place within its range, in the lower bits of ``monotonically_increasing_id``.
PLACE_BITS = 33


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Adds ``_at`` (places in the order of keys and ``order``, ascending but not gapless) and ``_seg`` (the range that the
    row lies in). Ranges hold about as many rows each, so that a hot key has many; ties of all columns stay together. The
    rows are written to the shared folder once."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    return written(ranged).withColumn("_seg", F.shiftright("_at", PLACE_BITS))


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    out = F.col(f"{left}._seg") == F.col(f"{right}._seg")
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _joined(ranged: DataFrame, border: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``border`` (_seg, keys, names) has at most one row per range: the state that its first key comes in with."""
    kept = [F.col(f"r.{c}") for c in ranged.columns]
    return ranged.alias("r").join(F.broadcast(border.alias("b")), _same("r", "b", keys), "left").select(*kept, *(F.col(f"b.{n}").alias(n) for n in names))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str) -> DataFrame:
    """Adds ``out``: the rows' numbers from 0 within each key. ``df`` may come from ``ranges`` of the same order."""
    ranged = df if "_seg" in df.columns else ranges(df, keys, order)
    runs = ranged.groupBy("_seg", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))
    ends = _ends(ranged)
    # A key that spans ranges is the last of each but its last one: only those runs are carried on.
    open_ = runs.join(F.broadcast(ends.select(F.col("_seg").alias("_s"), "_last", "_first")), F.col("_seg") == F.col("_s")).where("_lo = _first or _lo + _n - 1 = _last").drop("_s")
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))
    border = open_.withColumn("_before", before).where("_before > 0").select("_seg", *keys, "_before")
    with_runs = W.partitionBy("_seg", *keys).orderBy("_at")
    rows = _joined(ranged, border, keys, ["_before"])
    return rows.withColumn(out, F.row_number().over(with_runs) - 1 + F.coalesce("_before", F.lit(0))).drop("_before")


def _ends(ranged: DataFrame) -> DataFrame:
    return ranged.groupBy("_seg").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Mapping[str, tuple[Column, bool]]) -> DataFrame:
    """Adds for each name the last non-null value of an expression among the key's rows before this one (itself included
    if the flag says so). ``df`` may come from ``ranges`` of the same order."""
    ranged = df if "_seg" in df.columns else ranges(df, keys, order)
    given = ranged.withColumns({f"_v_{name}": value for name, (value, _) in values.items()})
    names = list(values)
    # The border state: per range the last value of the range's last key, and whether the whole range is that key.
    last = given.groupBy("_seg", *keys).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), *(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_l_{n}") for n in names))
    ends = _ends(ranged).select(F.col("_seg").alias("_s"), "_first", "_last")
    open_ = last.join(F.broadcast(ends), F.col("_seg") == F.col("_s")).where("_lo = _first or _hi = _last")
    earlier = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    border = open_.select("_seg", *keys, *(F.last(f"_l_{n}", ignorenulls=True).over(earlier).alias(f"_b_{n}") for n in names)).where(" or ".join(f"_b_{n} is not null" for n in names))
    run = W.partitionBy("_seg", *keys).orderBy("_at")
    found = {n: F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, 0 if own else -1)), F.col(f"_b_{n}")) for n, (_, own) in values.items()}
    rows = _joined(given, border, keys, [f"_b_{n}" for n in names])
    return rows.withColumns(found).drop(*(f"{x}{n}" for n in names for x in ("_v_", "_b_")))


def bare(df: DataFrame) -> DataFrame:
    """Without the columns of ``ranges``."""
    return df.drop("_at", "_seg")
