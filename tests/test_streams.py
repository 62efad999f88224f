"""Keyed streams over several files whose events are out of order, against folds of all rows in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import history
from lexatlas.sources.crawl import history_sink
from lexatlas.streaming import jobs, ordered
from lexatlas.streaming.ordered import use_rocksdb

START = dt.datetime(2024, 1, 1)
SCHEMA = "client_id string, url string, content_hash string, text string, ts timestamp"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Three files of events in any order, one that moves the watermark far on, one more (Spark drops late rows by the
    watermark of the batch before), and one with an event too late."""
    rng, path = random.Random(41), str(tmp_path_factory.mktemp("events"))
    rows = [(rng.choice("abc"), "u", rng.choice(["h1", "h2", "h3", None]), "x" * rng.choice([0, 10, 300, 310, 320, 3100]), START + dt.timedelta(seconds=rng.randrange(86400))) for _ in range(240)]
    rng.shuffle(rows)
    far = [("z", "u", "h", "", START + dt.timedelta(days=20))]
    more = [("z", "u", "h", "", START + dt.timedelta(days=21))]
    late = [("a", "u", "late", "y" * 9000, START + dt.timedelta(hours=1)), ("z", "u", "h", "", START + dt.timedelta(days=40))]
    for i, part in enumerate([rows[:80], rows[80:160], rows[160:], far, more, late]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}/f{i}")
    return path, rows


def drained(spark, files, job, tmp_path):
    use_rocksdb(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{files[0]}/f*")
    out = job(stream)
    history_sink(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out") + "/batch=*").collect()


def in_order(rows, value):
    """Rows of each client by time, equal times by null first and value."""
    keys: dict = {}
    for r in sorted(rows, key=lambda r: (r[4], r[value] is not None, r[value] or "")):
        keys.setdefault(r[0], []).append((r[4], r[value]))
    return keys


def test_history(spark, files, tmp_path):
    rows = [r for r in files[1] if r[2]]
    job = lambda s: jobs.stream_history(s.where("content_hash is not null"), 600, "3 days")
    got = {(r["client_id"], r["content_hash"], r["ts"], r["action"]) for r in drained(spark, files, job, tmp_path) if r["client_id"] != "z"}
    batch = history.collapse_rescans(spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 600)
    assert got == {(r["client_id"], r["content_hash"], r["ts"], r["action"]) for r in batch.collect()}


def test_version_changes(spark, files, tmp_path):
    job = lambda s: jobs.stream_version_changes(s.withColumnRenamed("client_id", "domain"), "3 days")
    want = []
    for key, events in in_order(files[1], 2).items():
        last = None
        for ts, h in events:
            if h and last and h != last:
                want.append((key, last, h, ts))
            last = h or last
    assert sorted((r["domain"], r["prev_hash"], r["content_hash"], r["ts"]) for r in drained(spark, files, job, tmp_path)) == sorted(want)


def test_longest_text(spark, files, tmp_path):
    job = lambda s: jobs.stream_longest_text(s.withColumnRenamed("client_id", "page"), "3 days")
    want = []
    for key, events in in_order(files[1], 3).items():
        most = 0
        for ts, text in events:
            if len(text) > most:
                most = len(text)
                want.append((key, ts, text))
    assert sorted((r["page"], r["ts"], r["text"]) for r in drained(spark, files, job, tmp_path)) == sorted(want)


def test_converged_on_the_longest_text(spark, files, tmp_path):
    job = lambda s: jobs.stream_converged(s.withColumnRenamed("client_id", "page"), late="3 days")
    want = []
    for key, events in in_order(files[1], 3).items():
        longest, same = 0, 0
        for ts, text in events:
            longest, same = (len(text), 0) if len(text) > longest else (longest, same + 1)
            if longest >= 3000 or (longest >= 300 and same >= 2):
                want.append((key, ts, longest))
                break
    assert sorted((r["page"], r["ts"], r["length"]) for r in drained(spark, files, job, tmp_path)) == sorted(want)


def test_windows_drop_late_rows(spark, files, tmp_path):
    job = lambda s: jobs.stream_alert_rate(s.select(F.col("client_id").alias("site"), "ts", F.lit(True).alias("needs_attention")), late="2 days")
    got = drained(spark, files, job, tmp_path)
    assert sum(r["scans"] for r in got if r["site"] != "z") == len(files[1])  # each once, and the one that came too late not


def test_fetches_by_kind(spark, files, tmp_path):
    """Kinds that serve for different times, over events out of order."""
    ttl = {"h1": 60_000, "h2": 1_800_000, "h3": 24 * 3600_000}
    job = lambda s: jobs.stream_fetches(s.where("content_hash is not null").select(F.lit("u").alias("canonical_url"), F.col("content_hash").alias("kind"), "ts"), ttl, "3 days")
    want, last = [], {}
    for _, _, kind, _, ts in sorted((r for r in files[1] if r[2]), key=lambda r: r[4]):
        if kind not in last or (ts - last[kind]).total_seconds() * 1000 >= ttl[kind]:
            want.append((kind, ts))
            last[kind] = ts
    got = [(r["kind"], r["ts"]) for r in drained(spark, files, job, tmp_path) if r["kind"] in ttl]
    assert sorted(got) == sorted(want)


def test_state_ends_with_its_time_to_live(spark, files, tmp_path):
    """A hash that comes again after the time to live is new."""
    job = lambda s: jobs.stream_signature_changes(s.select(F.col("client_id").alias("page"), "ts", F.lit("u").alias("url"), F.lit("t").alias("text"), F.array().cast("array<string>").alias("trackers"), F.array().cast("array<string>").alias("labels")), "3 days", 3600_000)
    got = sorted((r["page"], r["ts"]) for r in drained(spark, files, job, tmp_path) if r["page"] != "z")
    want = []
    for key, events in in_order(files[1], 2).items():
        times = [ts for ts, _ in events]
        want += [(key, t) for p, t in zip([None, *times], times, strict=False) if p is None or (t - p).total_seconds() >= 3600]
    assert got == sorted(want)


def test_hot_key_waits_in_leaves(spark, tmp_path):
    """One key with many rows out of order: all are folded in order, from leaves of bounded size."""
    n = 30_000
    rows = spark.range(n).select(F.lit("k").alias("client_id"), F.lit("u").alias("url"), F.lit("h").alias("content_hash"), F.format_string("%05d", "id").alias("text"), F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000).alias("ts"))
    for i, part in enumerate(rows.orderBy(F.rand(1)).randomSplit([0.5, 0.5], 1)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    for i in range(2):
        spark.createDataFrame([("z", "u", "h", "x", START + dt.timedelta(days=9 + i))], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/f9{i}")
    got = drained(spark, (f"{tmp_path}/in",), lambda s: jobs.stream_version_changes(s.select(F.col("client_id").alias("domain"), F.col("text").alias("content_hash"), "ts"), "9 days"), tmp_path)
    assert sorted((r["prev_hash"], r["content_hash"]) for r in got) == [(f"{i:05d}", f"{i + 1:05d}") for i in range(n - 1)]


def test_leaves_are_bounded():
    rng = random.Random(1)
    events = ordered.event_order((rng.randrange(10**9), "x" * rng.randrange(3000)) for _ in range(20_000))
    leaves = ordered._split(events)
    assert [e for leaf in leaves for e in leaf] == events
    assert max(map(len, leaves)) <= ordered.LEAF_ROWS and max(sum(len(v) for _, v in leaf) for leaf in leaves) <= ordered.LEAF_CHARS
    one = [(5, str(i)) for i in range(5000)]
    assert ordered._split(one) == [one]
