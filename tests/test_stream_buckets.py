"""Keyed streams hold their state by buckets of keys, not by key."""

import datetime as dt
import random

from lexatlas.sources.crawl import history_sink
from lexatlas.streaming import jobs, ordered
from lexatlas.streaming.ordered import use_rocksdb

START = dt.datetime(2024, 1, 1)


class Kept(dict):
    """Value and map state of one bucket."""

    def get(self):
        return dict.get(self, ())

    def update(self, value):
        self[()] = value

    getValue, updateValue = dict.__getitem__, dict.__setitem__  # noqa: N815


class Handle:
    def getMapState(self, *_):  # noqa: N802
        return Kept()

    getValueState = getMapState  # noqa: N815


def test_slices_keep_a_growing_map():
    rng, want = random.Random(3), {}
    kept = ordered.Slices(Handle(), "m", 2, "n long")
    for _ in range(30):
        kept.load()
        for _ in range(300):
            key = (str(rng.randrange(3000)), rng.choice(["", None, "ü"]))
            assert kept.get(key) == want.get(key)
            value = (rng.randrange(100),) if rng.random() < 0.8 else None
            kept.put(key, value)
            want = {k: v for k, v in (want | {key: value}).items() if v}
        kept.flush()
        assert kept.numbers.get()[0] == len(want)
    assert len(kept.slices) == kept.numbers.get()[1] > 1
    assert all(len(columns[0]) < 2 * ordered.SLICE for columns in kept.slices.values())
    assert kept.retain(lambda _, v: v[0] < 50) == sum(v[0] < 50 for v in want.values())
    kept.load()
    assert all(kept.get(k) == (v if v[0] < 50 else None) for k, v in want.items())
    assert kept.retain(lambda *_: False) == 0 == len(kept.slices)


def test_many_keys_in_few_state_rows(spark, tmp_path):
    """2,000 keys of three rows in a few buckets: results by key, and no state row per key."""
    use_rocksdb(spark)
    rows = [(f"k{i}" if i else None, "ab"[j % 2], START + dt.timedelta(minutes=(i * 7 + j * 60) % 5000)) for i in range(2000) for j in range(3)]
    random.Random(5).shuffle(rows)
    schema = "page string, signature string, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/f0")
    for i in range(2):
        spark.createDataFrame([("z", "x", START + dt.timedelta(days=9 + i))], schema).coalesce(1).write.parquet(f"{tmp_path}/in/f9{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/f*")
    fold = lambda key, state, us, s: ([(key[0], us, s)] if not state or state[0] != s else [], (s,))
    out = "page string, ts timestamp, signature string"
    changes = ordered.in_event_order(stream, ["page"], "signature", ordered.InEventOrder(["page", "ts", "signature"], "signature string", fold, 30 * jobs.DAY_MS), out, "5 days", buckets=16)
    query = history_sink(changes, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 500
    got = {(r["page"], r["ts"], r["signature"]) for r in spark.read.schema(changes.schema).parquet(str(tmp_path / "out") + "/batch=*").collect() if r["page"] != "z"}
    want, last = set(), {}
    for page, s, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        if last.get(page) != s:
            want.add((page, ts, s))
        last[page] = s
    assert got == want


def test_histories_begin_anew_and_end():
    """A page's hashes end with its time to live, whatever other pages of its bucket do."""
    job = ordered.Histories(["client_id", "content_hash", "ts", "action"], 1, 1000)
    job.keys = ["client_id"]
    job.init(Handle())
    second = 1_000_000
    first = list(job.step([(0, "h", "a"), (500_000, "g", "b"), (900_000, "h", "b")]))
    assert [r[-1] for r in first] == ["insert", "insert", "overwrite"]
    assert [r[-1] for r in job.step([(5 * second, "h", "a"), (5 * second, "g", "b")])] == ["insert", "insert"]
    assert job.sweep(5 * second - 1) == 2 and job.rows.retain(lambda *_: True) == 2
    assert job.sweep(5 * second) == 0 and not job.rows.slices
