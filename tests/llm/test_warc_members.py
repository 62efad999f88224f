"""Members of several records, whole-file compression, damage inside, and the size of written archives."""

import gzip
import random

from pyspark.sql import functions as F

from lexatlas.llm import common, warc

from .test_operators import record

PARTS = [record(i, f"payload {i} ".encode() * random.Random(i).randrange(5, 60)) for i in range(5)]


def seen(data, **k):
    rows = list(warc.scan(data, **k))
    assert sum(r["length"] for r in rows) == len(data)
    return [r["page_id"] for r in rows if r["kind"] == "record"], [(r["offset"], r["length"], r["reason"]) for r in rows if r["kind"] == "gap"]


def test_several_records_in_a_member():
    whole = gzip.compress(b"".join(PARTS))
    assert seen(whole) == ([0, 1, 2, 3, 4], [])
    assert seen(whole + PARTS[2] + gzip.compress(PARTS[0] + PARTS[1])) == ([0, 1, 2, 3, 4, 2, 0, 1], [])


def test_damaged_record_in_a_sound_member():
    bad = bytearray(PARTS[1])
    bad[-9] ^= 1
    records, gaps = seen(gzip.compress(PARTS[0] + bytes(bad) + PARTS[2]))
    a, b = len(PARTS[0]), len(PARTS[1])
    assert records == [0, 2] and gaps == [(0, 0, f"wrong digest at bytes {a} to {a + b} of the member")]


def test_cut_and_damaged_members_give_what_comes_before():
    rng = random.Random(3)
    noisy = [record(i, bytes(rng.randrange(32, 127) for _ in range(3000))) for i in range(20)]
    whole = gzip.compress(b"".join(noisy))
    records, gaps = seen(whole[: len(whole) // 2] + gzip.compress(PARTS[4]))
    assert records[:-1] == list(range(len(records) - 1)) and len(records) >= 8 and records[-1] == 4
    assert len(gaps) == 1 and gaps[0][:2] == (0, len(whole) // 2)


def test_expansion_is_bounded():
    bomb = gzip.compress(b"WARC/1.0\r\n" + b"\0" * (1 << 22))
    assert seen(bomb + gzip.compress(PARTS[0]), most=1 << 20) == ([0], [(0, len(bomb), "member too large")])


def test_archives_are_bounded_whatever_the_order_of_sizes(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST_BYTES", 400_000)
    pages = spark.range(200).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat(cast(id as string), if(id > 180, 40000, 3))").alias("html"))
    path = common.new_shared_path(spark)
    warc.write_archives(pages, path, compress=False, archive_bytes=10 << 20)
    assert max(r["length"] for r in spark.read.format("binaryFile").load(path).select("length").collect()) <= 500_000


def test_tied_smallest_id_beside_null(spark):
    page = "<p>" + "same " * 50
    rows = [(None, "u", page), (3, "u", page), (3, "v", page), (9, "w", page), (9, "w", "short")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), common.new_shared_path(spark)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("3", "response", None), ("3", "response", None), ("9", "response", None), ("9", "revisit", 3), ("None", "revisit", 3)]
