"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sum, small_or_shuffled

WORD = r"[^\x20\x09-\x0D]+"
#: So many words, or one of each source, may be sorted one by one at the cut.
FEW = 100_000


def source_targets(sizes: DataFrame, weights: Sequence[int], budget_share: float, max_repeats: int) -> DataFrame:
    """(source, source_size, rank, before, most, target) from (source, size) rows.

    Sources in code-point order (null last) take ``weights`` in turn and share ``budget_share`` of all sizes; a target
    stops at ``max_repeats`` times the source's size and the excess is shared anew by weight until none is above.
    Each round is one aggregate over the sources; only its two sums come to the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sum(prefix_sum(per, order, "one", "rank"), order, "source_size", "upto")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    ranked = materialize(
        ranked.select(
            "source", "source_size", "rank", (F.col("upto") - F.col("source_size")).alias("before"),
            F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * max_repeats).alias("most"),
        )
    )
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, F.lit(False)
    while True:
        held, open_weight = ranked.agg(F.sum(F.when(full, F.col("most")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not open_weight or (now := (budget_share * total - held) / open_weight) == level:
            break
        level = now
        full = F.col("most") <= F.col("weight") * F.lit(level)
    target = F.when(full, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return materialize(ranked.withColumn("target", target))


def words_until(time: float, target: Column) -> Column:
    """How many words a source has sent at a virtual time: the largest k with k / target <= time, as doubles compare."""
    k = F.floor(F.lit(time) * target)
    return k + F.when((k + 1) / target <= time, 1).otherwise(0) - F.when(k / target > time, 1).otherwise(0)


def cut_time(sources: DataFrame, budget: int, ways: int = 32) -> tuple[float, float]:
    """Virtual times (before, until) such that the ``sources`` (target, most) have sent fewer than ``budget`` words at the
    first and no fewer at the second, and at most FEW, or one of each source, between. Each round sums up what the
    sources have sent at ``ways`` times between, and goes on within the two that hold the budget."""
    sources = sources.where("target > 0 and most > 0")
    sent = lambda t: F.sum(F.least(words_until(t, F.col("target")), F.col("most")))
    n, last = sources.agg(F.count("*"), F.max(F.col("most") / F.col("target"))).first()
    before, until = 0.0, float(last or 0)
    low, high = 0, sources.agg(sent(until)).first()[0] or 0
    if high < budget:
        return until, until
    while high - low > max(n, FEW):
        times = [t for t in np.unique(np.linspace(before, until, ways + 2)[1:-1]).tolist() if before < t < until]
        if not times:
            break
        for t, words in zip(times, sources.agg(*(sent(t).alias(f"w{i}") for i, t in enumerate(times))).first(), strict=True):
            if words < budget:
                before, low = t, words
            else:
                until, high = t, words
                break
    return before, until


def cut_queue(entries: DataFrame, sources: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """Cut the merged queue of ``entries`` (row, rank, tie, size, end, target; size > 0) at ``budget`` words.

    A word that its source sends as the k-th has the virtual finish time k / target, and the mix is the first ``budget``
    words of all sources by finish time and rank. Entries are range-sorted by the time of their last word and summed up.
    The time at which the budget is reached is found from the ``sources`` (``cut_time``); entries that end before it are
    taken whole, those that begin after it are not, and of those open then the words before it. The few words at the time
    itself are sorted one by one. Returns (row, words) of the words taken, and the sorted entries with ``mix_end``, the
    words of entries up to each.
    """
    timed = entries.withColumn("finish", F.col("end") / F.col("target"))
    ordered = prefix_sum(timed, ["finish", "rank", "tie", "end", "row"], "size", "mix_end")
    before, until = cut_time(sources, budget)
    first = F.col("end") - F.col("size")
    of = lambda t: F.greatest(F.lit(0), F.least(words_until(t, F.col("target")) - first, F.col("size"))).cast("long")
    sent = ordered.withColumn("sure", of(before)).withColumn("near", of(until) - F.col("sure"))
    rest = budget - (sent.agg(F.sum("sure")).first()[0] or 0)
    words = sent.where("near > 0").select("row", "rank", "target", F.explode(F.sequence(first + F.col("sure") + 1, first + F.col("sure") + F.col("near"))).alias("k"))
    words = words.select("row", "rank", (F.col("k") / F.col("target")).alias("time"), F.lit(1).cast("long").alias("one"))
    placed = prefix_sum(words, ["time", "rank"], "one", "place").where(F.col("place") <= rest)
    part = placed.groupBy("row").agg(F.sum("one").alias("words"))
    return sent.where("sure > 0").select("row", F.col("sure").alias("words")).unionByName(part), ordered


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget_share: float = 1.5, max_repeats: int = 2, seed: str = "mix",
) -> DataFrame:
    """Mix the sources of ``docs`` (doc_id, text, source, ...) to their target weights.

    Each source's documents stand in a queue, shuffled by an MD5 of doc_id and ``seed`` and passed ``max_repeats``
    times. A word's virtual finish time is the source's words up to it divided by the source's target; a document's is
    that of its last word. The entries of all sources are range-sorted by finish time and the mix is cut at the total
    budget (``cut_queue``): what a document gives is what stands before the cut, so sources meet their targets because
    the order is fair, within a word or two.

    Returns one row per input row: doc_id, source, size, source_size, target, taken, finish (of the first pass) and
    position (words of the entries that finish before its first pass; null if nothing is taken). Words are runs of anything but blank,
    tab, LF, VT, FF, CR. Null or empty texts have size 0 and are never taken; a null doc_id is shuffled as an empty
    string; repeated rows are documents of their own, in an order that does not change their taken words as a set;
    an empty table gives an empty result. Other columns of the input are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = materialize(docs.select("doc_id", "source", size.alias("size")).withColumn("row", F.monotonically_increasing_id()))
    targets = source_targets(base, weights, budget_share, max_repeats)
    total = targets.agg(F.sum("source_size")).first()[0]
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    mine = base.join(
        small_or_shuffled(targets.select(F.col("source").alias("t_source"), "rank", "source_size", "before", "target")),
        F.col("source").eqNullSafe(F.col("t_source")),
    ).drop("t_source").withColumn("key", key)
    queued = prefix_sum(mine, ["rank", "key", "doc_id", "size", "row"], "size", "upto")
    passes = queued.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("tie", F.explode(F.array(*(F.lit(i) for i in range(max_repeats)))))
    end = F.col("upto") - F.col("before") + F.col("tie") * F.col("source_size")
    entries = passes.select("row", "rank", "tie", "size", end.alias("end"), "target")
    taken, ordered = cut_queue(entries, targets.select("target", "most"), int(min(budget_share, max_repeats) * (total or 0)))
    firsts = ordered.where("tie = 0").select("row", F.lit(0).cast("long").alias("words"), (F.col("mix_end") - F.col("size")).alias("at"))
    given = taken.withColumn("at", F.lit(None).cast("long")).unionByName(firsts).groupBy("row").agg(F.sum("words").alias("taken"), F.min("at").alias("at"))
    first = F.when(F.col("target") > 0, (F.col("upto") - F.col("before")) / F.col("target"))
    return (
        queued.join(materialize(given).withColumnRenamed("row", "t_row"), F.col("row") == F.col("t_row"), "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), first.alias("finish"), F.when(F.col("taken") > 0, F.col("at")).alias("position"))
    )
