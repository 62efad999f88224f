"""Records whose headers are long."""

import gzip

import pytest
from pyspark.sql import functions as F

from lexatlas.llm import common, warc

LONG = "data:text/html," + "x" * 150_000


@pytest.mark.parametrize("compress", [True, False])
def test_long_urls_are_read_back(spark, compress):
    rows = [(1, LONG, "<p>one"), (2, "https://a.example/" + "?q=" * 40_000, "<p>two"), (3, "https://b.example/", "<p>three"), (4, LONG + "y", "z" * 300), (5, LONG + "z", "z" * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.new_shared_path(spark)
    got = warc.archive_pages(pages, path, compress).collect()
    assert sorted((r["page_id"], r["record_type"]) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "response"), (5, "revisit")]
    found = warc.read_archives(spark, path)
    assert found.where("kind = 'gap'").count() == 0
    assert {r["page_id"]: r["target_uri"] for r in found.collect()} == {i: u for i, u, _ in rows}


def test_long_urls_count_for_archive_size(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), F.repeat(F.lit("u"), 50_000)).alias("url"), F.lit("<p>").alias("html")).coalesce(1)
    path = common.new_shared_path(spark)
    warc.write_archives(pages, path, compress=False, archive_bytes=500_000)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) >= 4 and max(r["length"] for r in files) <= 1_000_000


def test_long_and_damaged_headers():
    def record(i, fields=b""):
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\n%sContent-Length: 2\r\n\r\nhi\r\n\r\n" % (i, fields)

    long = record(1, b"X-Note: " + b"n" * 300_000 + b"\r\n")
    cut = b"WARC/1.1\r\nWARC-Type: response\r\n"
    for pack in (bytes, gzip.compress):
        seen = list(warc.scan(pack(record(0)) + pack(long) + cut + pack(record(2)) + cut))
        assert [r["page_id"] for r in seen if r["kind"] == "record"] == [0, 1, 2]
        assert [r["length"] for r in seen if r["kind"] == "gap"] == [len(cut), len(cut)]
