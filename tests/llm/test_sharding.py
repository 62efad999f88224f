"""Even shards: counts, slots, whole groups, quotas, odd rows."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lexatlas.llm.sharding import numbered, running_sum, shard_documents

SCHEMA = "doc_id long, text string"


def checked(spark, rows, shards):
    out = shard_documents(spark.createDataFrame(rows, SCHEMA), shards).collect()
    given = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == given
    counts = Counter(r["shard"] for r in out)
    n = len(rows)
    assert [counts[s] for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r["law"] for r in out} <= {"rows"} and all(r["grown_shard"] is None for r in out)
    homes = defaultdict(Counter)
    for r in out:
        homes[r["size"], r["text_crc32"]][r["shard"]] += 1
    return homes


def test_groups_stay_whole(spark):
    rows = [(i, f"text {i}") for i in range(700)] + [(1000 + i, f"copy {i % 60}") for i in range(240)]
    homes = checked(spark, rows, 24)
    assert all(len(h) == 1 for k, h in homes.items() if sum(h.values()) > 1)
    assert len({s for h in homes.values() if sum(h.values()) == 4 for s in h}) > 8  # they do not crowd


def test_copies_only_and_large_groups(spark):
    rows = [(i, f"pair {i // 2}") for i in range(480)]
    assert sum(len(h) - 1 for h in checked(spark, rows, 24).values()) == 0
    rows = [(i, "same") for i in range(300)] + [(i, f"own {i}") for i in range(300, 600)] + [(i, f"three {i // 3}") for i in range(600, 900)]
    homes = checked(spark, rows, 10)
    assert len(homes[12, zlib.crc32(b"same")]) <= 4 and sum(len(h) - 1 for h in homes.values()) <= 5
    assert len(checked(spark, [(1, "x")] * 100, 7)) == 1


def test_odd_rows(spark):
    rows = [(None, None), (1, None), (1, None), (2, ""), (3, ""), (None, "é"), (4, "é" * 200_000), (4, "é" * 200_000), (5, "x")]
    checked(spark, rows, 4)
    checked(spark, rows, 24)
    assert shard_documents(spark.createDataFrame([], SCHEMA), 24).count() == 0
    wide = spark.createDataFrame([(1, "a", 1, 2, "s", 3)], "doc_id long, text string, shard int, row int, digest string, slot int")
    assert shard_documents(wide, 3).first()["shard"] == 0


def test_groups_of_another_kind(spark):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    out = shard_documents(df, 5, group=F.when(F.col("doc_id") < 90, F.floor(F.col("doc_id") / 9)))
    homes = defaultdict(set)
    for r in out.where("doc_id < 90").collect():
        homes[r["doc_id"] // 9].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_reruns_agree(spark):
    rows = [(i % 150, f"t{i % 90}") for i in range(400)]
    one, two = (Counter(shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(n), 24).collect()) for n in (2, 7))
    assert one == two


def test_numbers_and_sums(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50, i % 5) for i in range(300)], "g int, k int, v int").withColumn("row", F.monotonically_increasing_id())
    rows = numbered(df, ["g", "k", "row"], "n", "g").collect()
    for g in range(3):
        own = sorted((r["n"], r["k"]) for r in rows if r["g"] == g)
        assert [n for n, _ in own] == list(range(100)) and [k for _, k in own] == sorted(k for _, k in own)
    total = Counter()
    for r in sorted(running_sum(df, "g", ["k", "row"], "v", "sum").collect(), key=lambda r: (r["g"], r["k"], r["row"])):
        total[r["g"]] += r["v"]
        assert r["sum"] == total[r["g"]]


def test_plan_has_no_python(spark):
    plan = shard_documents(spark.createDataFrame([(1, "a"), (2, "a")], SCHEMA), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
