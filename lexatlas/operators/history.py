"""Versions of documents and histories of scans."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import bare, carried, numbered, ranges
from ..functions.text import present, sentences
from ..rules import CONSENT_WORDS

LEGACY_CLIENT = "legacy"


def reuse_analyses(docs: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J2. Documents (doc_id, url, text, content_hash) with the stored analysis_id of the same address and hash, and those
    still to do. Texts with consent words are always done anew; a null hash never matches; of several stored
    analyses the newest counts."""
    stored = analyses.where("content_hash is not null").groupBy("url", "content_hash").agg(F.max_by("analysis_id", F.struct("created_at", "analysis_id")).alias("analysis_id"))
    fixed = docs.where(present(F.col("text"), CONSENT_WORDS) < 2)
    hits = fixed.join(stored, ["url", "content_hash"]).select("doc_id", "analysis_id")
    return hits, docs.join(hits.select("doc_id"), "doc_id", "left_anti")


def previous_snapshot(docs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """J3. (doc_id, prev_hash, prev_at): the domain's latest snapshot before the document's time ``ts`` (of equal times that
    with the largest hash). An as-of join as one scan over the union of both, in ranges of domain and time."""
    both = docs.select("domain", "ts", "doc_id", F.lit(None).cast("string").alias("h"), F.lit(0).alias("kind")).unionByName(
        snapshots.select("domain", F.col("created_at").alias("ts"), F.lit(None).cast("long").alias("doc_id"), F.col("content_hash").alias("h"), F.lit(1).alias("kind"))
    )
    found = carried(both, ["domain"], ["ts", "kind", "h", "doc_id"], {"p": (F.when(F.col("kind") == 1, F.struct("h", "ts")), False)})
    return found.where("kind = 0").select("doc_id", F.col("p.h").alias("prev_hash"), F.col("p.ts").alias("prev_at"))


def version_status(docs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """U3. (doc_id, status, prev_at): new, unchanged or changed against the previous snapshot."""
    df = docs.select("doc_id", "content_hash").join(previous_snapshot(docs, snapshots), "doc_id")
    status = F.when(F.col("prev_hash").isNull(), "new").when(F.col("prev_hash") == F.col("content_hash"), "unchanged").otherwise("changed")
    return df.select("doc_id", status.alias("status"), "prev_at")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """W9. Newest version per domain: a pre-aggregated maximum, no sort."""
    return snapshots.groupBy("domain").agg(F.max_by(F.struct("content_hash", "created_at"), F.struct("created_at", "content_hash")).alias("s")).select("domain", "s.*")


def sentence_changes(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """U1. (key, type, sentence, n) between two versions (key, text): added and removed sentences, as multisets. One
    aggregate of +1 and -1 over both, so nothing is joined."""
    rows = cur.select("key", F.explode(sentences(F.col("text"))).alias("sentence"), F.lit(1).alias("d")).unionByName(prev.select("key", F.explode(sentences(F.col("text"))).alias("sentence"), F.lit(-1).alias("d")))
    net = rows.groupBy("key", "sentence").agg(F.sum("d").alias("d")).where("d <> 0")
    return net.select("key", F.when(F.col("d") > 0, "added").otherwise("removed").alias("type"), "sentence", F.abs("d").alias("n"))


def sentence_sequence_diff(prev: DataFrame, cur: DataFrame, limit: int = 20) -> DataFrame:
    """U2. (key, place, type, sentence): the first ``limit`` changes in order, removed before added where a block is
    replaced. Pairs of versions are rows (joined by key where the text differs), so each diff is one row's work."""
    pairs = cur.select("key", sentences(F.col("text")).alias("cur")).join(prev.select("key", sentences(F.col("text")).alias("prev")), "key").where("cur <> prev")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, new, old in zip(pdf["key"], pdf["cur"], pdf["prev"], strict=True):
                new, old, found = list(new), list(old), []
                for op, a, b, c, d in difflib.SequenceMatcher(None, old, new).get_opcodes():
                    if op != "equal":
                        found += [("removed", s) for s in old[a:b]] + [("added", s) for s in new[c:d]]
                rows += [(key, i, *x) for i, x in enumerate(found[:limit])]
            yield pd.DataFrame(rows, columns=["key", "place", "type", "sentence"])

    return pairs.mapInPandas(run, "key string, place int, type string, sentence string")


def change_timeline(snapshots: DataFrame) -> DataFrame:
    """U6. (domain, created_at, prev_at, added, removed) of consecutive versions, of which a domain has one at a time. Versions
    are numbered in ranges of domain and time; each sentence's hash goes to its own version as +1 and to the next number
    as -1, so what meets is narrow and no domain is gathered."""
    order = bare(numbered(snapshots.select("domain", "created_at"), ["domain"], ["created_at"], "n"))
    texts = snapshots.select("domain", "created_at", F.transform(sentences(F.col("text")), lambda s: F.xxhash64(s)).alias("hashes"))
    rows = order.join(texts, ["domain", "created_at"])
    none = F.lit(None).cast(snapshots.schema["created_at"].dataType)
    own = rows.select("domain", "n", "created_at", none.alias("prev_at"), F.explode_outer("hashes").alias("h"), F.lit(1).alias("d"))
    past = rows.select("domain", (F.col("n") + 1).alias("n"), none.alias("created_at"), F.col("created_at").alias("prev_at"), F.explode_outer("hashes").alias("h"), F.lit(-1).alias("d"))
    both = own.unionByName(past).repartition("domain", "n")
    at = [F.max(c).alias(c) for c in ("created_at", "prev_at")]
    net = both.groupBy("domain", "n", "h").agg(*at, F.sum(F.when(F.col("h").isNotNull(), F.col("d")).otherwise(0)).alias("d"))
    counts = net.groupBy("domain", "n").agg(*at, F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))
    return counts.where("created_at is not null and prev_at is not null").drop("n")


def page_key(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def recent_history(analyses: DataFrame, k: int = 10) -> DataFrame:
    """W10. The newest k rows of each client (no client: one shared one), with their rank."""
    df = analyses.withColumn("client_id", F.coalesce("client_id", F.lit(LEGACY_CLIENT)))
    rank = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("created_at"), F.desc("analysis_id")))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def mru_pages(scans: DataFrame, k: int) -> DataFrame:
    """W11. (client_id, page_key, last_ts, rank): pages of each client by last visit, newest first. Each task passes on its
    first ``k`` of a client only (Spark limits ranked windows before the exchange)."""
    last = scans.groupBy("client_id", page_key(F.col("url")).alias("page_key")).agg(F.max("ts").alias("last_ts"))
    rank = F.row_number().over(W.partitionBy("client_id").orderBy(F.desc("last_ts"), "page_key"))
    return last.withColumn("rank", rank).where(F.col("rank") <= k)


def recently_counted(scans: DataFrame, k: int = 5) -> DataFrame:
    """W12. Adds counted: is the page among the client's previous k rows that have an address. Rows are numbered per client
    in ranges of client and time, and compared with the number of the page's last row, in ranges of client and page."""
    keyed = scans.where("url is not null").withColumn("page_key", page_key(F.col("url")))
    rows = bare(numbered(keyed, ["client_id"], ["ts", "scan_id"], "_n"))
    found = bare(carried(rows, ["client_id", "page_key"], ["_n"], {"_prev": (F.col("_n"), False)}))
    return found.withColumn("counted", F.coalesce(F.col("_n") - F.col("_prev") <= k, F.lit(False))).drop("_n", "_prev")


def rescan_sessions(scans: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """W13, gap part. (client_id, url, first_ts, last_ts, scans, content_hash): scans of a page by a client that follow within
    the gap (a gap of just that length included), and their last hash. Scans without a time are one session of their page.
    One write in ranges of page and time serves both scans: for the time before, and for the session's first."""
    rows = ranges(scans.select("client_id", "url", "ts", "content_hash"), ["client_id", "url"], ["ts", "content_hash"])
    rows = carried(rows, ["client_id", "url"], ["ts", "content_hash"], {"prev": (F.col("ts"), False)})
    new = F.col("prev").isNull() | (F.col("ts") > F.col("prev") + F.expr(f"INTERVAL {gap}"))
    rows = carried(rows, ["client_id", "url"], ["ts", "content_hash"], {"session": (F.when(new, F.col("ts")), True)})
    return rows.groupBy("client_id", "url", "session").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("scans"), F.max_by("content_hash", F.struct("ts", "content_hash")).alias("content_hash")).drop("session")


def collapse_rescans(scans: DataFrame, gap_seconds: int = 600) -> DataFrame:
    """W13. (client_id, url, content_hash, ts, action) of every scan's decision: overwrite (a page scanned within the gap
    with another hash), bump (a hash seen before: all rows of the page take the time), or insert.

    The fold reads each page's scans in order of (ts, content_hash) as a stream and holds only the page's rows so far,
    one per distinct hash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []  # rows of the page: [hash, time], newest state last
        for pdf in batches:
            actions = []
            for client, url, h, ts in zip(pdf["client_id"], pdf["url"], pdf["content_hash"], pdf["ts"], strict=True):
                if (client, url) != key:
                    key, held = (client, url), []
                latest = max(held, key=lambda r: r[1], default=None)
                if latest and (ts - latest[1]).total_seconds() <= gap_seconds and h != latest[0]:
                    latest[:] = [h, ts]
                    actions.append("overwrite")
                elif any(r[0] == h for r in held):
                    for r in held:
                        r[1] = ts
                    actions.append("bump")
                else:
                    held.append([h, ts])
                    actions.append("insert")
            yield pdf.assign(action=actions)

    rows = scans.select("client_id", "url", "content_hash", "ts").repartition("client_id", "url").sortWithinPartitions("client_id", "url", "ts", "content_hash")
    return rows.mapInPandas(run, "client_id string, url string, content_hash string, ts timestamp_ntz, action string")


def cap_newest(rows: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """W14. The newest n rows overall; a top-n of each partition and of those."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def fresh_entries(cache: DataFrame, ttl: str, now: str) -> DataFrame:
    """W15. Entries younger than the time to live; ``now`` is given, so reruns agree."""
    return cache.where(F.col("ts") > F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {ttl}"))


def derive_analyses(stored: DataFrame) -> DataFrame:
    """S6. Stored analyses with missing scores as 0 and missing labels derived from the score."""
    from .risk import score_label

    score = F.coalesce("safety_score", F.lit(0))
    return stored.withColumn("safety_score", score).withColumn("safety_prediction", F.coalesce("safety_prediction", score_label(score)))


def new_snapshots(docs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """S5. Documents (domain, content_hash, ...) that differ from their domain's latest snapshot, each version once."""
    latest = latest_snapshot(snapshots).select("domain", F.col("content_hash"))
    return docs.join(latest, ["domain", "content_hash"], "left_anti").dropDuplicates(["domain", "content_hash"])


def snapshot_rows(docs: DataFrame, analyses: DataFrame) -> DataFrame:
    """S5. (domain, content_hash, raw_text, analysis_json, created_at if given) of documents (domain, content_hash, text) and the analyses
    (domain, content_hash, ...) of the same version, as JSON; null where there is none."""
    fields = [c for c in analyses.columns if c not in ("domain", "content_hash")]
    packed = analyses.select("domain", "content_hash", F.to_json(F.struct("domain", *fields)).alias("analysis_json"))
    one = packed.groupBy("domain", "content_hash").agg(F.max("analysis_json").alias("analysis_json"))
    time = ["created_at"] if "created_at" in docs.columns else []
    return docs.join(one, ["domain", "content_hash"], "left").select("domain", "content_hash", F.col("text").alias("raw_text"), "analysis_json", *time)
