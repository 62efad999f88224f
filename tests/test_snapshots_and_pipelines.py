"""Bucketed snapshot tables, and the pipelines that other tests do not run."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from lexatlas.operators import history
from lexatlas.plans import pipelines
from lexatlas.sources import crawl

DOCS = "domain string, content_hash string, text string, created_at int"


@pytest.fixture
def table(spark):
    name = f"snapshots_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_snapshot_table(spark, table):
    analyses = spark.createDataFrame([("d0", "h0", 7), ("d1", "h9", 8)], "domain string, content_hash string, safety_score int")
    batch = spark.createDataFrame([(f"d{i}", f"h{i}", f"text {i}", 1) for i in range(30)] + [("d0", "h0", "text 0", 1)], DOCS)
    for _ in range(2):
        crawl.append_snapshot_table(batch, analyses, table, 4)
    later = spark.createDataFrame([("d1", "h9", "new", 2), ("d2", "h2", "text 2", 2), ("d99", "x", None, 2)], DOCS)
    rows = crawl.append_snapshot_table(later, analyses, table, 4).collect()
    got = {(r["domain"], r["content_hash"]): r for r in rows}
    assert len(rows) == len(got) == 32 and got["d1", "h9"]["raw_text"] == "new" and got["d99", "x"]["raw_text"] is None
    assert json.loads(got["d0", "h0"]["analysis_json"]) == {"domain": "d0", "safety_score": 7} and got["d2", "h2"]["analysis_json"] is None


def test_stored_side_has_no_exchange(spark, table):
    batch = spark.createDataFrame([(f"d{i}", f"h{i}", "t", 1) for i in range(30)], DOCS)
    stored = crawl.append_snapshot_table(batch, batch.select("domain", "content_hash").limit(0), table, 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(history.latest_snapshot(stored)) == 0
        docs = batch.select("domain", "content_hash")
        latest = history.latest_snapshot(stored).select("domain", F.col("content_hash").alias("h"))
        assert exchanges(docs.join(latest, "domain", "left")) <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snapshots_in_a_folder_hold_text_and_analysis(spark, tmp_path):
    batch = spark.createDataFrame([("d", "h1", "old", 1), ("d", "h2", "new", 2), ("d", "h2", "new", 2)], DOCS)
    snaps = spark.createDataFrame([("d", "h1", 1)], "domain string, content_hash string, created_at int")
    analyses = spark.createDataFrame([("d", "h2", 3)], "domain string, content_hash string, safety_score int")
    crawl.append_snapshots(batch, snaps, str(tmp_path), analyses)
    (row,) = spark.read.parquet(str(tmp_path)).collect()
    assert (row["raw_text"], json.loads(row["analysis_json"])["safety_score"], row["created_at"]) == ("new", 3, 2)


PROSE = "This policy explains which data we collect and why we need them. You may ask us to delete them at any time. "


def test_clean_corpus(spark):
    page = lambda body: f"<html><body><nav>Home</nav><p>{body}</p></body></html>"
    rows = [
        (1, "https://a.example/privacy?utm_source=x", 200, page(PROSE * 6)),
        (2, "https://a.example/privacy", 200, page(PROSE * 6 + "More.")),
        (3, "https://b.example/x", 404, page(PROSE * 6)),
        (4, "https://b.example/y", 200, page(PROSE * 6)),
        (5, "https://c.example/", 200, page("thin") + "<div></div>" * 200),
        (6, "https://c.example/app", 200, page("thin") + "<div></div>" * 200),
        (7, "https://d.example/", 200, page("Diese Erklärung sagt, welche Daten wir erheben und wozu wir sie brauchen. Sie können sie jederzeit löschen lassen. " * 6)),
        (8, "https://e.example/", 200, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, status int, html string").withColumn("content_type", F.lit("text/html"))
    shown = spark.createDataFrame([(6, (PROSE + "Shown by script. ") * 6)], "page_id long, rendered_text string")
    docs, lost = pipelines.clean_corpus(df, shown)
    kept = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept) == {1, 6, 7} and kept[1]["lang"] == "en" and kept[7]["lang"] == "de" and kept[6]["chosen"] == "rendered"
    assert all("Home" not in r["text"] and r["tokens"] > 40 and r["content_hash"] for r in kept.values())
    reasons = {r["doc_id"]: r["reason"] for r in lost.collect()}
    assert reasons == {2: "not_prose_or_repeated", 3: "http_error", 4: "not_prose_or_repeated", 5: "js_rendered", 8: "too_thin"}
    raw = df.where("page_id = 7").select("page_id", "url", "status", F.lit("text/html; charset=iso-8859-1").alias("content_type"), F.encode("html", "iso-8859-1").alias("body"))
    assert "Erklärung" in pipelines.clean_corpus(raw)[0].first()["text"]


def test_version_and_scan_history(spark):
    docs = spark.createDataFrame([(1, "d", 5, "h1"), (2, "d", 5, "h2"), (3, "new", 5, "h")], "doc_id long, domain string, ts int, content_hash string")
    snaps = spark.createDataFrame([("d", "h1", 3), ("d", "h0", 1), ("d", "h7", 5)], "domain string, content_hash string, created_at int")
    status, fresh = pipelines.version_history(docs, snaps)
    assert {r["doc_id"]: r["status"] for r in status.collect()} == {1: "unchanged", 2: "changed", 3: "new"}
    assert {r["doc_id"] for r in fresh.collect()} == {1, 2, 3}  # the latest of all is h7
    scans = spark.createDataFrame([("c", "u/", "a", 0), ("c", "u/", "b", 300), ("c", "u", "c", 9000)], "client_id string, url string, content_hash string, t int").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    decided, recent = pipelines.scan_history(scans.withColumn("scan_id", F.col("t").cast("long")))
    assert sorted(r["action"] for r in decided.collect()) == ["insert", "insert", "overwrite"]
    assert [(r["page_key"], r["rank"]) for r in recent.collect()] == [("u", 1)]
