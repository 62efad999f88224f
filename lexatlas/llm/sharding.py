"""Even shards that keep linked documents together, by balanced label propagation. Built-in Spark functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, small_or_shuffled

#: A row's place within its partition, in the lower bits of ``monotonically_increasing_id``.
PLACE_BITS = 33


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """The rows in range partitions of ``order``, with ``_at``: the partition's number and the row's place in it."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_at", F.monotonically_increasing_id()))


def numbered(df: DataFrame, order: list[str | Column], out: str, within: str | None = None) -> DataFrame:
    """Adds ``out``: the rows' gapless numbers from 0 in ``order``, which begins with ``within`` where each value of it has
    numbers of its own. No task sees more than a range of the rows; what is summed up in one task has a row per partition
    (and value of ``within``)."""
    placed = _ranged(df, order).withColumn("_pid", F.shiftright("_at", PLACE_BITS))
    keys = [within] if within else []
    runs = placed.groupBy("_pid", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("_pid").alias("_of"), *(F.col(k).alias(f"_{k}") for k in keys), (before - F.col("_first")).alias("_shift"))
    same = F.col("_pid") == F.col("_of")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return placed.join(F.broadcast(runs), same).withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_pid", "_of", "_shift", *(f"_{k}" for k in keys))


def running_sum(df: DataFrame, within: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the inclusive running sum of ``value`` in ``order`` within each ``within``. Partitions are summed by
    themselves; one total per partition and value of ``within`` is summed up in one task."""
    placed = _ranged(df, [within, *order]).withColumn("_pid", F.shiftright("_at", PLACE_BITS))
    local = placed.withColumn("_sum", F.sum(value).over(W.partitionBy("_pid", within).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)))
    totals = placed.groupBy("_pid", within).agg(F.sum(value).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(within).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("_pid").alias("_of"), F.col(within).alias("_in"), before.alias("_before"))
    both = local.join(F.broadcast(totals), (F.col("_pid") == F.col("_of")) & (F.col(within) == F.col("_in")))
    return both.withColumn(out, F.col("_sum") + F.col("_before")).drop("_at", "_pid", "_of", "_in", "_sum", "_before")


def propagate(members: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """Move ``members`` (bundle, shard, ...) towards the shards of the others of their bundle, which ends ``settled`` or not.

    A bundle's votes are its members per shard. In each round every open bundle aims at the shard with most votes among those
    that have room for all of it (ties by a hash, so that bundles spread). The quota of a shard is its ``room`` less the
    members settled there; bundles are admitted up to it, the largest first, then those with least to move, and their
    members follow by a join. A round settles at least one bundle if any fits; rounds end when none does.
    """
    shards = range(len(room))
    members = members.withColumn("settled", F.lit(False))
    for _ in range(rounds):
        held = {r["shard"]: r["count"] for r in members.where("settled").groupBy("shard").count().collect()}
        quota = [room[s] - held.get(s, 0) for s in shards]
        free = F.array(*(F.lit(q).cast("long") for q in quota))
        votes = members.where("not settled").groupBy("bundle").agg(F.count("*").alias("size"), F.array(*(F.count_if(F.col("shard") == s) for s in shards)).alias("votes"))
        options = F.transform("votes", lambda v, s: F.struct(v.alias("votes"), F.xxhash64("bundle", s).alias("tie"), s.alias("shard")))  # noqa: B023
        aims = votes.withColumn("aim", F.array_max(F.filter(options, lambda o: F.col("size") <= free[o["shard"]]))).where("aim is not null")  # noqa: B023
        aims = aims.select("bundle", F.col("aim.shard").alias("aim"), "size", (F.col("size") - F.col("aim.votes")).alias("need"))
        aims = running_sum(aims, "aim", [F.desc("size"), "need", "bundle"], "size", "upto")
        admitted = materialize(aims.where(F.col("upto") <= free[F.col("aim")]).select(F.col("bundle").alias("moved"), "aim"))
        if admitted.isEmpty():
            break
        followed = members.join(small_or_shuffled(admitted), F.col("bundle") == F.col("moved"), "left")
        members = materialize(followed.withColumns({"shard": F.coalesce("aim", "shard"), "settled": F.col("settled") | F.col("aim").isNotNull()}).drop("moved", "aim"))
    return members


def shard_documents(docs: DataFrame, shards: int = 24, group: Column | None = None, rounds: int = 24) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, ...) into one of ``shards`` whose row counts differ by one at most (law
    "rows"), with linked rows in one shard where they fit.

    Rows are linked if they have the same ``group`` (default: the text; near-duplicate classes do as well); a null group
    links nothing. Linked rows start evenly dealt and move by balanced label propagation (``propagate``); the quota of
    a shard is its final number of rows. A group larger than a shard is first cut into bundles that fit. The bundles that
    fit into no shard any more, then the rows without links in hash order, fill the shards up. Nothing but keys, sizes
    and digests is shuffled; a group's rows are never gathered.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text and 8), text_crc32 (of the UTF-8 bytes), law, shard
    (from 0), slot (gapless from 0 within the shard, by doc_id), grown_shard (null under this law) and linked. A null text
    has no bytes: size 8, checksum 0, and no links by text; empty texts are equal. Repeated rows are rows of their own. A null
    doc_id is ordered first. With fewer rows than shards the last shards are empty; an empty table gives an empty
    result. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.sha2("text", 256) if group is None else F.sha2(group.cast("string"), 256)
    base = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("digest"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()))
    total = base.count()
    room = [total // shards + (s < total % shards) for s in range(shards)]
    most = max(total // shards, 1)
    groups = base.where("digest is not null").groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1")
    groups = small_or_shuffled(materialize(groups.withColumnRenamed("digest", "of")))
    tagged = materialize(base.join(groups, F.col("digest") == F.col("of"), "left").drop("of"))

    linked = numbered(tagged.where("rows is not null"), ["digest", "doc_id", "row"], "at")
    large = linked.where(F.col("rows") > most).groupBy(F.col("digest").alias("of")).agg(F.min("at").alias("first"))  # no more than shards
    bundle = F.xxhash64("digest", F.floor((F.col("at") - F.coalesce("first", "at")) / most))
    linked = linked.join(F.broadcast(large), F.col("digest") == F.col("of"), "left").withColumn("bundle", bundle).withColumn("shard", (F.col("at") % shards).cast("int"))
    linked = propagate(materialize(linked.drop("of", "first", "at", "rows")), room, rounds)

    held = {r["shard"]: r["count"] for r in linked.where("settled").groupBy("shard").count().collect()}
    filled = [sum(room[i] - held.get(i, 0) for i in range(s + 1)) for s in range(shards)]
    loose = tagged.where("rows is null").withColumn("mix", F.xxhash64("doc_id", "digest")).withColumn("last", F.lit(1)).drop("rows")
    loose = loose.unionByName(linked.where("not settled").withColumn("last", F.lit(0)).withColumnRenamed("bundle", "mix").drop("shard", "settled"))
    loose = numbered(loose, ["last", "mix", "doc_id", "row"], "at")
    loose = loose.withColumn("shard", sum((F.when(F.col("at") >= end, 1).otherwise(0) for end in filled[:-1]), F.lit(0)))
    columns = ["doc_id", "size", "text_crc32", "shard", "row"]
    placed = linked.where("settled").select(*columns, F.lit(True).alias("linked")).unionByName(loose.select(*columns, (F.col("last") == 0).alias("linked")))
    return numbered(placed, ["shard", "doc_id", "text_crc32", "size", "row"], "slot", "shard").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked"
    )
