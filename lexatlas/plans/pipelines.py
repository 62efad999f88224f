"""User-facing pipelines: each reads and writes tables and is a chain of the jobs in operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.shared import written
from ..operators import consent, history, model, pages, risk, sampling
from ..operators import urls as links


def clean_corpus(crawl: DataFrame, rendered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, rejected) of fetched pages (page_id, url, status, content_type, and html or body): one row per canonical address
    and text that reads as prose from beginning to end; the others with their reason.

    Bodies are decoded; a page without enough static text takes the prose of its scripts, else its ``rendered`` text (page_id,
    rendered_text); texts lose boilerplate, are scored and gated, and get their language and variety of words."""
    if "html" not in crawl.columns:
        crawl = crawl.join(pages.decode_bodies(crawl).select("page_id", F.col("text").alias("html")), "page_id")
    # Pages are parsed once, scripts of pages without enough static text only, and texts meet no others but rendered ones.
    static = crawl.select("page_id", "url", "status", "content_type", "html", pages.strip_tags(F.col("html")).alias("static_text"))
    thin = ~F.coalesce(F.length("static_text") >= 200, F.lit(False))
    found = static.select("*", pages.payload_text(F.when(thin, F.col("html"))).alias("_payload"))
    parts = found.withColumns({"payload_text": F.when(pages.is_payload_text(F.col("_payload")), F.col("_payload")), "outcome": pages.outcome_of(F.coalesce("static_text", F.lit("")))})
    parts = parts.select("page_id", "url", "static_text", "payload_text", "outcome")
    parts = parts.withColumn("rendered_text", F.lit(None).cast("string")) if rendered is None else parts.join(rendered.select("page_id", "rendered_text"), "page_id", "left")
    text = pages.strip_boilerplate(parts.select("page_id", *pages.chosen_text(), "url", "outcome"))
    # Text from elsewhere mends what was wrong with the static one only.
    mended = (F.col("chosen") != "static") & F.col("outcome").isin("js_rendered", "too_thin", "source_code")
    rows = written(text.withColumn("outcome", F.when(mended, "ok").otherwise(F.col("outcome"))).withColumnRenamed("page_id", "doc_id"))
    docs = links.cache_key_urls(links.canonical_urls(pages.prose_quality(rows.where("outcome = 'ok'"), limit=None))).withColumn("domain", urls.domain(F.col("url")))
    gated = written(pages.prose_gate(docs))
    first = pages.dedupe_text(gated).groupBy("canonical_url").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    kept = written(gated.withColumn("content_hash", F.sha2("text", 256)).join(first, "doc_id", "left_semi").drop("outcome"))
    lost = rows.select("doc_id", "outcome").join(kept.select("doc_id"), "doc_id", "left_anti")
    facts = pages.with_variety(pages.with_language(kept).withColumnRenamed("detected", "lang"))
    return facts, lost.select("doc_id", F.when(F.col("outcome") == "ok", "not_prose_or_repeated").otherwise(F.col("outcome")).alias("reason"))


def find_legal_pages(crawl: DataFrame, sitemap: DataFrame | None = None, disabled: DataFrame | None = None, k: int = 12) -> DataFrame:
    """Ranked legal links of each page (page_id, page_url, pos, href, label, score). Addresses of the sitemap
    (site, pos, url) go to the first page of their origin, behind its links."""
    wanted = links.exclude_disabled_domains(crawl, disabled) if disabled is not None else crawl
    found, _ = links.veto_urls(links.self_link_filter(links.extract_links(wanted)))
    ranked = links.resolve_translated_duplicates(links.rank_legal_links(found, k).drop("rank"))
    if sitemap is not None:
        more = links.supplement_candidates(ranked, links.rank_legal_urls(sitemap))
        homes = wanted.groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.min_by(F.struct("page_id", F.col("url").alias("page_url")), "page_id").alias("home"))
        pos = 100000 + F.row_number().over(W.partitionBy("origin").orderBy(F.desc("score"), "url"))
        own = more.withColumn("pos", pos).join(homes, "origin").select("home.*", "pos", F.col("url").alias("href"), F.lit("").alias("label"), "score")
        ranked = ranked.unionByName(own)
    return ranked


def risk_report(docs: DataFrame, trackers: DataFrame, controls: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(findings, scores, alerts, worklist) of docs (doc_id, text), trackers per document (doc_id, n_trackers) and consent
    controls (page_id = doc_id, label, action), whose risky choices lower the score. Findings and facts are written once, since
    three results use them."""
    findings = written(risk.rule_findings(docs))
    facts = written(risk.disclosure_facts(docs))
    cookies = None
    if controls is not None:
        choices = consent.cookie_choice_breakdown(controls, docs.select(F.col("doc_id").alias("page_id"), "text"))
        cookies = choices.select(F.col("page_id").alias("doc_id"), "all_risk")
    alerts = risk.declared_vs_observed(facts, trackers)
    flags = risk.alert_flags(findings, alerts)
    return findings, risk.safety_scores(docs, findings, trackers, cookies), flags, risk.opt_out_worklist(facts, findings)


def consent_audit(crawl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, controls) of the consent dialogs of pages (page_id, html)."""
    segments = consent.outermost_segments(consent.consent_signal_filter(consent.consent_segments(crawl)))
    return segments, consent.consent_controls(segments)


def version_history(docs: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, snapshots to append) of docs (doc_id, domain, ts, content_hash, ...)."""
    return history.version_status(docs, snapshots), history.new_snapshots(docs, snapshots)


def scan_history(scans: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(decisions, recent pages) of a scan log."""
    return history.collapse_rescans(scans), history.mru_pages(scans, k)


def model_batch(docs: DataFrame, providers: Mapping[str, model.Provider], default: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, rejected) of documents (doc_id, text, translated_text, lang): inputs, provider chain, parsed answers."""
    inputs = model.analysis_inputs(docs).withColumnRenamed("doc_id", "id")
    return model.parse_responses(model.enrich(inputs, providers, default))


def budgeted_context(blocks: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text): blocks sampled to a common budget, in order."""
    sampled = sampling.sample_blocks(sampling.allocate_budget(blocks, budget))
    return sampling.reassemble(sampled.select("doc_id", F.col("block_no").alias("chunk_no"), F.col("sample").alias("chunk")))
