"""Golden cases, invariants and oracle comparisons of the policy-corpus jobs."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import chunk_reference
from lexatlas import queries, rules
from lexatlas.functions import urls as U
from lexatlas.operators import consent, history, model, pages, risk, sampling
from lexatlas.operators import urls as links
from lexatlas.plans import pipelines
from lexatlas.sources import crawl

SF = "/root/testdata/sf0.001"
TABLES = "documents pages events labels conversations benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(rows):
    return sorted(tuple(repr(float(f"{v:.9g}")) if isinstance(v, float) else repr(v) for v in r) for r in rows)


#: One of each family; the driver compares all of them.
CHECKED = [
    "p1_canonical_urls", "p4_extract_links", "p10_prose_quality", "p21_detect_language", "s8_fetch_outcomes", "w1_rank_legal_links", "w4_translated_duplicates", "s3_sitemap_urls", "w7_outermost_segments",
    "r1_rule_findings", "r3_safety_scores", "a9_site_risk_profile", "j1_match_trackers", "j3_previous_snapshot", "u1_sentence_changes", "u6_change_timeline", "w12_recently_counted", "w13_rescan_sessions",
    "c2_sample_blocks", "l3_enrich", "l4_parse_responses", "t3_stream_version_changes", "t8_stream_alert_rate", "flagship_worst_sites",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = rows_of(tuple(r) for r in df.select(*cols).collect())
    found = duck.execute(queries.ORACLES[name])
    at = [c[0] for c in found.description]
    assert sorted(at) == cols
    assert got == rows_of([r[at.index(c)] for c in cols] for r in found.fetchall())


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "url string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b"), [("https://x.com/a#top", "https://x.com/a"), ("https://x.com/a/?utm_source=feed&gclid=1", "https://x.com/a"), ("https://X.com", "https://x.com/"), ("https://x.com/a?b=1&ref=z", "https://x.com/a?b=1")])
def test_canonical(spark, a, b):
    key = U.canonical(F.col("url"), rules.TRACKING_PARAMS)
    assert one(spark, a, key) == one(spark, b, key)


def test_literal_reading_keeps_utm(spark):
    literal = [(p, "exact" if m == "prefix" else m) for p, m in rules.TRACKING_PARAMS]
    assert one(spark, "https://x.com/a?utm_source=feed", U.canonical(F.col("url"), literal)).endswith("utm_source=feed")


def test_link_scores(spark):
    rows = [(1, "https://s.com/x", 0, "https://s.com/us/p/thin-cookies/1016533491", "Thin cookies".replace("cookies", "biscuits")), (1, "https://s.com/x", 1, "https://s.com/us/p/privacy/1016533491", "Privacy policy"), (1, "https://s.com/x", 2, "https://s.com/statiya/pravila-i-usloviya/339282/", "more")]
    got = {r["pos"]: r["score"] for r in links.score_links(spark.createDataFrame(rows, "page_id int, page_url string, pos int, href string, label string")).collect()}
    assert got[0] == -100 and got[1] > 0 and got[2] == 13


def test_slug_tokens_are_whole(spark):
    rows = [("s", 1, "https://s.de/illegale-schatzsuche"), ("s", 2, "https://s.de/legalisierung"), ("s", 3, "https://s.de/privacy-policy")]
    assert [r["url"] for r in links.rank_legal_urls(spark.createDataFrame(rows, "site string, pos int, url string")).collect()] == ["https://s.de/privacy-policy"]


def test_translated_duplicates_prefer_page_language(spark):
    rows = [(1, "https://s.com/en/home", 0, "https://s.com/de/agb/339282", "x", 9), (1, "https://s.com/en/home", 1, "https://s.com/en/terms/339282", "x", 5), (1, "https://s.com/en/home", 2, "https://s.com/about", "x", 1)]
    got = links.resolve_translated_duplicates(spark.createDataFrame(rows, "page_id int, page_url string, pos int, href string, label string, score int")).collect()
    assert sorted(r["pos"] for r in got) == [1, 2]


def test_self_and_home_links(spark):
    rows = [(1, "https://s.com/a", i, h, "") for i, h in enumerate(["https://s.com/a#x", "https://s.com/#", "https://s.com/?ref=footer", "https://s.com/b"])]
    got = links.self_link_filter(spark.createDataFrame(rows, "page_id int, page_url string, pos int, href string, label string")).collect()
    assert [r["pos"] for r in got] == [3]


def test_prose_scores(spark):
    texts = ["short", "Item 12.99 Item 13.99 Item 14.99 Item 15.99 Item 16.99 and Item 17.99 again", "We keep the data that you give us for as long as the law asks. " * 8]
    got = [r["prose_score"] for r in pages.prose_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == 0 and got[1] < 0.55 <= got[2] <= 1


def scores(spark, text, findings=(), trackers=0):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    f = spark.createDataFrame([(1, x) for x in findings], "doc_id long, attention_level string")
    return risk.safety_scores(docs, f, spark.createDataFrame([(1, trackers)], "doc_id long, n_trackers int")).first()["score"]


def test_safety_scores(spark):
    assert scores(spark, "fine", ["LOW"] * 9) == 85
    assert scores(spark, "we may train our models") == 65
    low = scores(spark, "text", ["HIGH", "MEDIUM"], 2)
    assert scores(spark, "text with mandatory arbitration", ["HIGH", "MEDIUM"], 2) <= low


def test_labels(spark):
    got = [r["l"] for r in spark.createDataFrame([(i, s) for i, s in enumerate([85, 84, 65, 64, 40, 39, 20, 19])], "i int, s int").orderBy("i").select(risk.score_label(F.col("s")).alias("l")).collect()]
    assert got == ["Very safe", "Mostly safe", "Mostly safe", "Use with caution", "Use with caution", "Risky", "Risky", "High risk"]


def test_alert_needs_a_declaration(spark):
    rows = spark.createDataFrame([(1, None), (2, False), (3, True)], "doc_id long, declared_sharing boolean")
    got = risk.declared_vs_observed(rows, spark.createDataFrame([(1, 3), (2, 3), (3, 3)], "doc_id long, n_trackers int"))
    assert {r["doc_id"] for r in got.where("detected").collect()} == {2}


def test_evidence_follows_pattern_order(spark):
    docs = spark.createDataFrame([(1, "third parties come first, then advertising partners")], "doc_id long, text string")
    got = risk.first_pattern_evidence(docs, [("P", "HIGH", "t", ["advertising partners", "third parties"], "")], 5, 0).first()["evidence"]
    assert got == "then advertising partners"


def test_controls(spark):
    got = consent.consent_controls(spark.createDataFrame([(1, ["Reject all", "Manage cookies", "Accept all", "Hello", ""])], "page_id int, labels array<string>")).collect()
    assert [(r["label"], r["action"]) for r in got] == [("Reject all", "reject"), ("Manage cookies", "manage"), ("Accept all", "accept")]


def scan_rows(spark, rows):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, u, h, start + dt.timedelta(minutes=m)) for c, u, h, m in rows], "client_id string, url string, content_hash string, ts timestamp_ntz")


def test_rescans(spark):
    rows = [("a", "u", "h1", 0), ("a", "u", "h2", 10), ("b", "u", "h1", 0), ("a", "u", "h3", 21), ("a", "u", "h2", 40), ("c", "u", "h", 0), ("c", "u", "h", 5)]
    got = {(r["client_id"], r["content_hash"], r["ts"].minute): r["action"] for r in history.collapse_rescans(scan_rows(spark, rows)).collect()}
    assert got == {("a", "h1", 0): "insert", ("a", "h2", 10): "overwrite", ("a", "h3", 21): "insert", ("a", "h2", 40): "bump", ("b", "h1", 0): "insert", ("c", "h", 0): "insert", ("c", "h", 5): "bump"}
    assert history.rescan_sessions(scan_rows(spark, rows)).where("client_id = 'a'").count() == 3


def test_null_hash_is_a_miss(spark):
    docs = spark.createDataFrame([(1, "u", "plain", None), (2, "v", "plain", "h")], "doc_id long, url string, text string, content_hash string")
    stored = spark.createDataFrame([("x", "u", None, 1), ("y", "v", "h", 1), ("z", "v", "h", 2)], "analysis_id string, url string, content_hash string, created_at int")
    hits, todo = history.reuse_analyses(docs, stored)
    assert [(r["doc_id"], r["analysis_id"]) for r in hits.collect()] == [(2, "z")] and [r["doc_id"] for r in todo.collect()] == [1]


def test_changes_rebuild_the_version(spark):
    rng = random.Random(1)
    for _ in range(3):
        a, b = ([f"S{rng.randrange(9)}." for _ in range(12)] for _ in range(2))
        df = lambda s: spark.createDataFrame([("k", " ".join(s))], "key string, text string")
        left = list(a)
        for r in history.sentence_changes(df(a), df(b)).collect():
            for _ in range(r["n"]):
                left.append(r["sentence"]) if r["type"] == "added" else left.remove(r["sentence"])
        assert sorted(left) == sorted(b)
        seq = history.sentence_sequence_diff(df(a), df(b), 1000).collect()
        assert len(seq) >= sum(r["n"] for r in history.sentence_changes(df(a), df(b)).collect())


def test_chunks_hold_the_text():
    rng = random.Random(2)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "a. ", "\n\n", "x" * 50, "! "]) for _ in range(rng.randrange(80)))
        chunks = chunk_reference.split_chunks(text, 120)
        assert all(0 < len(c) <= 120 for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_budget(spark):
    blocks = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([100, 5000, 20000])], "doc_id long, block_no int, text string")
    got = sampling.allocate_budget(blocks, 4000).orderBy("block_no").collect()
    assert sum(r["share"] for r in got) <= 4000 and all(r["share"] >= 200 for r in got)
    assert len(pipelines.budgeted_context(blocks, 4000).first()["text"]) < 4500


def test_pipelines_and_tables(spark, tmp_path):
    pages_df = spark.read.parquet(f"{SF}/pages.parquet").withColumns({"status": F.lit(200), "content_type": F.lit("text/html")})
    docs, lost = pipelines.clean_corpus(pages_df)
    assert docs.count() + lost.count() == pages_df.count()
    links = pipelines.find_legal_pages(pages_df).collect()
    assert len({(r["page_id"], r["pos"]) for r in links}) == len(links) and all(r["score"] >= 0 for r in links)
    findings, scored, flags, work = pipelines.risk_report(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, n_trackers int"))
    assert scored.count() == flags.count() == docs.count() and work.count() <= docs.count() and findings.count() >= 0
    segments, controls = pipelines.consent_audit(pages_df)
    assert segments.count() == controls.count() == 0
    row = [(None, "c", "u", "d", "t", 50, None, "s", [], "h", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(row, crawl.ANALYSIS_SCHEMA)
    crawl.append_analyses(df, str(tmp_path / "a"))
    back = crawl.read_analyses(spark, str(tmp_path / "a")).first()
    assert back["safety_prediction"] == "Use with caution" and back["analysis_id"]
    snaps = spark.createDataFrame([("d", "h1", 1)], "domain string, content_hash string, created_at int")
    crawl.append_snapshots(spark.createDataFrame([("d", "h1", "t"), ("d", "h2", "t")], "domain string, content_hash string, text string"), snaps, str(tmp_path / "s"))
    assert [r["content_hash"] for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["h2"]


def test_model_batch(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "", "en") for i in range(9)], "doc_id long, text string, translated_text string, lang string")
    good = '{"domain":"a","safety_score":5,"summary":"s","findings":[]}'
    ok, bad = pipelines.model_batch(docs, {"one": lambda pdf: pdf[pdf["id"] % 2 == 0].assign(output=good)}, "no")
    assert {r["id"] for r in ok.collect()} == {0, 2, 4, 6, 8} and {r["reason"] for r in bad.collect()} == {"not_json"}
    assert model.conversation_messages(spark.createDataFrame([(1, 1, "user", "b"), (1, 0, "x", "a"), (1, 2, "user", " ")], "conv_id int, turn int, role string, text string")).first()["messages"][0]["role"] == "assistant"


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_history_equals_batch_fold(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.select(F.col("user_id").cast("string").alias("client_id"), F.concat(F.lit("https://app.example.com/"), "event_type").alias("url"), F.md5(F.floor(F.col("value") / 10).cast("long").cast("string")).alias("content_hash"), "ts")
    closed = rows.where(F.col("ts") <= events.agg(F.date_trunc("MILLISECOND", F.max("ts"))).first()[0])  # the watermark stands there at the end
    batch = history.collapse_rescans(closed, 12 * 3600).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = queries.QUERIES["t2_stream_history"](spark, SF)
    assert rows_of(batch.select(sorted(batch.columns)).collect()) == rows_of(stream.select(sorted(stream.columns)).collect())
