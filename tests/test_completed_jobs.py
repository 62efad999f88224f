"""Forms of links, payloads, samples, messages and answers that the given tables do not hold."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tests import chunk_reference
from lexatlas.operators import consent, history, model, pages, risk, sampling
from lexatlas.operators import urls as links
from lexatlas.plans import pipelines
from lexatlas.sources import crawl


def links_of(spark, html):
    df = spark.createDataFrame([(1, "https://x.com/a/b", html)], "page_id long, url string, html string")
    return [(r["href"], r["label"]) for r in links.extract_links(df).orderBy("pos").collect()]


def test_quoted_and_bare_links(spark):
    html = """<a href=/bare>B</a><a class="k" HREF = '/q?a=1&amp;b=2'>T &amp; C</a><a data-href="/no" href="/yes">Y</a><a title='it"s' href="o'k">K</a>
      <a data-href="/none">none</a><a href=#top>t</a><a href=javascript:void(0)>j</a><abbr href="/x">x</abbr><a\nhref=https://y.com/z/>Z</a>"""
    assert links_of(spark, html) == [
        ("https://x.com/bare", "B"), ("https://x.com/q?a=1&b=2", "T & C"), ("https://x.com/yes", "Y"), ("https://x.com/a/o'k", "K"), ("https://y.com/z/", "Z"),
    ]


def test_payload_marks_are_stripped(spark):
    prose = "We keep your data for 30 days, and null results are not kept. " * 5
    pushed = '5:["$","article",null,{"children":"' + prose + '"}]'
    html = "<script>self.push([1," + json.dumps(pushed) + "])</script>"
    got = pages.payload_prose(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["text"]
    assert prose.strip() in got and not any(m in got for m in ("$", "children", "5:", "]]", "}]"))


def test_slices_of_whole_words(spark):
    text = " ".join(f"word{i}" for i in range(900))
    df = spark.createDataFrame([(1, 0, text, 1200)], "doc_id long, block_no int, text string, share int")
    parts = sampling.sample_blocks(df, whole_words=True).first()["sample"].split(sampling.MARK)
    assert len(parts) == 4 and all(p.strip() in text for p in parts)
    assert all(w in text.split() for p in parts[2:] for w in p.split())
    assert sampling.sample_blocks(df.withColumn("text", F.repeat(F.lit("x"), 5000)), whole_words=True).first()["sample"].endswith("x" + sampling.MARK * 2)


def test_chunks_pack_neighbours_of_a_kind(spark):
    assert chunk_reference.split_chunks("ab\n\ncd\n\n\nef", 6) == ["ab\n\ncd", "ef"]
    assert chunk_reference.split_chunks("ab\n\nOne. Two. Sixteen letters.\n\ncd", 9) == ["ab", "One. Two.", "Sixteen l", "etters.", "cd"]
    assert chunk_reference.split_chunks("Aa. Bb. xxxxxxxxxxxx. Cc. Dd.", 8) == ["Aa. Bb.", "xxxxxxxx", "xxxx.", "Cc. Dd."]
    assert chunk_reference.split_chunks("", 5) == chunk_reference.split_chunks(None, 5) == chunk_reference.split_chunks(" \n\n ", 5) == []
    df = spark.createDataFrame([(1, "x. " * 100_000), (2, None)], "doc_id long, text string")
    cut = sampling.chunk_documents(df).agg(F.count("*").alias("n"), F.max("n_chunks").alias("all")).first()
    assert cut["n"] == 48 and cut["all"] == sampling.chunk_documents(df, None).count() > 48


def test_gate_by_legal_surface(spark):
    df = spark.createDataFrame([(1, "https://x.com/a", "t", True), (2, "https://x.com/b", "t", None), (3, "https://x.com/privacy", "t", False)], "doc_id long, url string, text string, surface boolean")
    assert {r["doc_id"] for r in risk.legal_document_gate(df, surface="surface").collect()} == {1, 3}
    assert {r["doc_id"] for r in risk.legal_document_gate(df).collect()} == {3}


def test_vendor_hosts(spark):
    df = spark.createDataFrame([(1, "a.com", "https://cmp.a.com/x"), (2, "b.com", "https://cdn.sp-prod.net/y"), (3, "c.com", "https://example.com/compare")], "page_id long, page_host string, resource_url string")
    assert {(r["vendor"], r["pages"]) for r in consent.cmp_vendors(df).collect()} == {("cmp.", 1), ("sp-prod", 1)}


def test_messages_of_a_question(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "bot", "b")], "conv_id int, turn int, role string, text string")
    table = lambda *rows: spark.createDataFrame(rows, "conv_id int, text string")
    got = {r["conv_id"]: [(m["role"], m["content"]) for m in r["messages"]] for r in model.conversation_messages(turns, "S", table((1, "D"), (2, None)), table((1, "q"), (2, "r"))).collect()}
    assert got == {1: [("system", "S"), ("system", "DOCUMENT CONTEXT:\nD"), ("user", "a"), ("assistant", "b"), ("user", "q")], 2: [("system", "S"), ("user", "r")]}


def test_all_fields_of_answers(spark):
    least = {"domain": "d", "safety_score": 90, "summary": "s", "findings": []}
    full = least | {
        "safety_prediction": "given", "can_opt_out": True, "privacy_email": "p@d.com", "hypocrisy_alert": {"detected": True, "trackers": ["t"]},
        "semantic_diff": {"has_changed": True, "changes": [{"type": "added", "text": "x"}]}, "cookie_breakdown": {"essential": {"label": "e"}, "all_optional": {"label": "a", "risk_level": "HIGH"}},
    }
    raw = spark.createDataFrame([(1, json.dumps(least)), (2, json.dumps(full)), (3, "{"), (4, None)], "id long, output string")
    good, bad = model.parse_responses(raw)
    a, b = good.orderBy("id").collect()
    assert (a["safety_prediction"], a["analysis_available"], a["can_opt_out"], a["detected_trackers"], a["cookie_breakdown"]) == ("Very safe", True, False, [], None)
    assert (b["safety_prediction"], b["can_opt_out"], b["privacy_email"], b["hypocrisy_alert"]["trackers"]) == ("given", True, "p@d.com", ["t"])
    assert b["semantic_diff"]["changes"][0]["text"] == "x" and b["cookie_breakdown"]["all_optional"]["risk_level"] == "HIGH"
    assert {(r["id"], r["reason"]) for r in bad.collect()} == {(3, "not_json"), (4, "not_json")}


def test_sitemap_addresses_go_to_one_page(spark):
    html = "<a href='/start'>x</a>"
    crawled = spark.createDataFrame([(i, f"https://x.com/p{i}", html) for i in (3, 1, 2)], "page_id long, url string, html string")
    sitemap = spark.createDataFrame([("x.com", i, f"https://x.com/{p}") for i, p in enumerate(["privacy-policy", "news", "cookie-policy"])], "site string, pos int, url string")
    got = pipelines.find_legal_pages(crawled, sitemap).collect()
    assert {(r["page_id"], r["href"]) for r in got} == {(1, "https://x.com/privacy-policy"), (1, "https://x.com/cookie-policy")}
    assert len({r["pos"] for r in got}) == 2


def test_cookie_choice_lowers_the_score(spark):
    docs = spark.createDataFrame([(1, "We share location, analytics and advertising data with third parties."), (2, "Nothing.")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, n_trackers int")
    controls = spark.createDataFrame([(1, "Accept all", "accept"), (1, "Only essential", "reject")], "page_id long, label string, action string")
    plain = {r["doc_id"]: r["score"] for r in pipelines.risk_report(docs, none)[1].collect()}
    lower = {r["doc_id"]: r["score"] for r in pipelines.risk_report(docs, none, controls)[1].collect()}
    assert lower[1] <= plain[1] and lower[2] == plain[2]


def test_repeated_batch_is_written_once(spark, tmp_path):
    row = [(None, "c", "u", "d", "t", 50, None, "s", [], "h", dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(row, crawl.ANALYSIS_SCHEMA)
    for batch in ("one", "one", "two"):
        crawl.append_analyses(df, str(tmp_path / "a"), batch)
    assert crawl.read_analyses(spark, str(tmp_path / "a")).count() == 2


def test_snapshot_rows(spark):
    docs = spark.createDataFrame([("d", "h", "text"), ("e", "h", "other")], "domain string, content_hash string, text string")
    done = spark.createDataFrame([("d", "h", 50)], "domain string, content_hash string, safety_score int")
    got = {r["domain"]: r for r in history.snapshot_rows(docs, done).collect()}
    assert got["d"]["raw_text"] == "text" and json.loads(got["d"]["analysis_json"]) == {"domain": "d", "safety_score": 50}
    assert got["e"]["analysis_json"] is None
