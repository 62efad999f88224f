"""Markers, findings, trackers, scores and alerts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.shared import written
from ..functions.text import present


def match_trackers(resources: DataFrame, trackers: DataFrame) -> DataFrame:
    """J1. Distinct (page_id, tracker_host): hosts that equal a tracker domain or lie below one, other than the page's own.
    Every host yields its suffixes, and the suffixes are joined by equality."""
    hosts = resources.select("page_id", "page_host", urls.hostname(F.col("resource_url")).alias("tracker_host")).where("tracker_host <> '' and tracker_host <> page_host").distinct()
    parts = F.split("tracker_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return hosts.withColumn("domain", F.explode(suffixes)).join(trackers.select("domain").distinct(), "domain").select("page_id", "tracker_host").distinct()


def tracker_summary(matches: DataFrame) -> DataFrame:
    """A5. (page_id, n_trackers, trackers): count and sorted list."""
    return matches.groupBy("page_id").agg(F.count_distinct("tracker_host").alias("n_trackers"), F.array_sort(F.collect_set("tracker_host")).alias("trackers"))


def match_rules(docs: DataFrame, markers: list[str]) -> DataFrame:
    """J6. (doc_id, marker) for each marker that occurs. Up to about a hundred markers are one projection; use
    match_rule_table for more."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = F.filter(F.array(*map(F.lit, markers)), lambda m: F.contains(low, m))
    return docs.select("doc_id", F.explode(found).alias("marker"))


def match_rule_table(docs: DataFrame, markers: DataFrame, block: int = 100_000) -> DataFrame:
    """J6 for a table of markers (marker) of any size: (doc_id, marker) for each distinct marker that a lower-cased text
    contains; an empty one is in every text but a null one, a null one in none.

    Markers are dealt into blocks of about ``block`` by hash; each is broadcast and becomes an Aho-Corasick automaton in the
    tasks, so texts are read once a block, however many markers it has. Of a text, only its distinct markers are held."""
    table = written(markers.select("marker").where("marker is not null").distinct())
    n = max(1, -(-table.count() // block))
    low = docs.select("doc_id", F.lower("text").alias("low")).where("low is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = None
    for i in range(n):
        part = [r["marker"] for r in table.where(F.pmod(F.xxhash64("marker"), F.lit(n)) == i).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for m in filter(None, shared.value):
                automaton.add_word(m, m)
            automaton.make_automaton()
            always = [m for m in shared.value if not m]
            for pdf in batches:
                rows = [(doc, m) for doc, text in zip(pdf["doc_id"], pdf["low"], strict=True) for m in [*always, *({m for _, m in automaton.iter(text)} if len(automaton) else ())]]
                yield pd.DataFrame(rows, columns=["doc_id", "marker"])

        hits = low.mapInPandas(search, f"doc_id {kind}, marker string")
        found = hits if found is None else found.unionByName(hits)
    return found


def marker_presence(docs: DataFrame, high: list[str] = rules.HIGH_MARKERS, network: list[str] = rules.NETWORK_MARKERS) -> DataFrame:
    """A3. (doc_id, high_hits, network_hits)."""
    return docs.select("doc_id", present(F.col("text"), high).alias("high_hits"), present(F.col("text"), network).alias("network_hits"))


def _opening(pattern: str) -> str:
    """Plain characters that each match of a pattern begins with, in lower case; none where the pattern has alternatives."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    head = re.match("[A-Za-z0-9 ]*", pattern)[0]
    return (head[:-1] if pattern[len(head) :][:1] in ("?", "*", "{") else head).lower()


def rule_matches(docs: DataFrame, rule_list: list = rules.FINDING_RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, text, matches): for each rule what its first pattern, in list order, that matches
    matches in the text; null if none does. One projection tries every pattern once, and only on texts that hold, in
    lower case, what its matches begin with.
    (Explode it with an outer generator: for others Catalyst would infer a filter that tries all patterns again.)"""
    text = F.coalesce(F.col("text"), F.lit(""))
    of = lambda p: F.when(F.contains("_low", F.lit(_opening(p))), F.regexp_extract("text", "(?i)(" + p + ")", 1)).otherwise("")
    tried = [[of(p).alias(f"_m{i}_{j}") for j, p in enumerate(rule[3])] for i, rule in enumerate(rule_list)]
    found = docs.select("doc_id", *carry, text.alias("text"), F.lower(text).alias("_low")).select("doc_id", *carry, "text", *(c for row in tried for c in row))
    first = [F.coalesce(*(F.when(F.col(f"_m{i}_{j}") != "", F.col(f"_m{i}_{j}")) for j in range(len(row)))) for i, row in enumerate(tried)]
    return found.select("doc_id", *carry, "text", F.array(*first).alias("matches"))


def first_pattern_evidence(docs: DataFrame, rule_list: list = rules.FINDING_RULES, before: int = 90, after: int = 180) -> DataFrame:
    """W16 and R1. (doc_id, rule_id, category, attention_level, title, evidence, explanation) of each rule that a text
    meets; evidence is what stands around the match of the rule's first pattern, in list order, that matches."""
    rows = rule_matches(docs, rule_list).select("doc_id", "text", F.posexplode_outer("matches").alias("rule_id", "match")).where("match is not null")
    of = lambda i: F.element_at(F.array(*(F.lit(r[i]) for r in rule_list)), F.col("rule_id") + 1)
    at = F.position(F.col("match"), F.col("text"))
    begin = F.greatest(F.lit(1), at - before)
    evidence = F.trim(F.substr("text", begin, at + F.length("match") + after - begin))
    return rows.select("doc_id", "rule_id", of(0).alias("category"), of(1).alias("attention_level"), of(2).alias("title"), evidence.alias("evidence"), of(4).alias("explanation"))


rule_findings = first_pattern_evidence


def rule_score(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """R2. (doc_id, score, summary) of the rules alone: 100 less 18 per HIGH and 9 per other finding, 20 at least."""
    per = findings.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("attention_level") == "HIGH", 18).otherwise(9)).alias("p"))
    df = docs.select("doc_id").join(per, "doc_id", "left")
    n = F.coalesce("n", F.lit(0))
    summary = F.when(n == 0, "No supported risk signal was found in the text.").otherwise(F.format_string("The rules found %d supported signal(s) in the text.", n))
    return df.select("doc_id", F.greatest(F.lit(20), 100 - F.coalesce("p", F.lit(0))).cast("int").alias("score"), summary.alias("summary"))


def finding_penalty(findings: DataFrame) -> DataFrame:
    """A4. (doc_id, penalty, has_high): 18, 9 and 3 by level."""
    weight = F.when(F.col("attention_level") == "HIGH", 18).when(F.col("attention_level") == "MEDIUM", 9).when(F.col("attention_level") == "LOW", 3).otherwise(0)
    return findings.groupBy("doc_id").agg(F.sum(weight).alias("penalty"), F.bool_or(F.col("attention_level") == "HIGH").alias("has_high"))


def score_label(score: Column) -> Column:
    return F.when(score >= 85, "Very safe").when(score >= 65, "Mostly safe").when(score >= 40, "Use with caution").when(score >= 20, "Risky").otherwise("High risk")


def safety_scores(docs: DataFrame, findings: DataFrame, trackers: DataFrame, cookies: DataFrame | None = None) -> DataFrame:
    """R3. (doc_id, high_hits, network_hits, n_trackers, score, label): 100 less the penalties of markers, findings,
    trackers and cookie choice; at most 65 with a high marker, a HIGH finding or four signs, else at least 85.
    trackers: (doc_id, n_trackers); cookies: (doc_id, all_risk). For findings from elsewhere; of rules see
    document_scores."""
    return _scored(marker_presence(docs).join(finding_penalty(findings), "doc_id", "left"), trackers, cookies)


def document_scores(docs: DataFrame, trackers: DataFrame, cookies: DataFrame | None = None, rule_list: list = rules.FINDING_RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """R3 with the findings of rules, in one pass over the texts: markers, matches and their penalties are columns of one
    projection, so only narrow rows meet the trackers. Adds the ``carry`` columns of docs."""
    met = lambda i: F.col("matches")[i].isNotNull()
    penalty = sum((F.when(met(i), 18 if r[1] == "HIGH" else 9 if r[1] == "MEDIUM" else 3).otherwise(0) for i, r in enumerate(rule_list)), F.lit(0))
    has_high = [met(i) for i, r in enumerate(rule_list) if r[1] == "HIGH"]
    rows = rule_matches(docs, rule_list, carry).select(
        "doc_id", *carry, present(F.col("text"), rules.HIGH_MARKERS).alias("high_hits"), present(F.col("text"), rules.NETWORK_MARKERS).alias("network_hits"),
        penalty.alias("penalty"), (F.greatest(*has_high, F.lit(False))).alias("has_high"),
    )
    return _scored(rows, trackers, cookies, carry)


def _scored(df: DataFrame, trackers: DataFrame, cookies: DataFrame | None, carry: tuple[str, ...] = ()) -> DataFrame:
    df = df.join(trackers.select("doc_id", "n_trackers"), "doc_id", "left")
    df = df.join(cookies.select("doc_id", "all_risk"), "doc_id", "left") if cookies is not None else df.withColumn("all_risk", F.lit(None).cast("string"))
    n = F.coalesce("n_trackers", F.lit(0))
    raw = 100 - 18 * F.col("high_hits") - 5 * F.col("network_hits") - F.coalesce("penalty", F.lit(0)) - F.least(F.lit(20), 4 * n) - F.when(F.col("all_risk") == "HIGH", 10).otherwise(0)
    risky = (F.col("high_hits") > 0) | F.coalesce("has_high", F.lit(False)) | (F.col("high_hits") + F.col("network_hits") + n >= 4)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.when(risky, F.least(raw, F.lit(65))).otherwise(F.greatest(raw, F.lit(85))))).cast("int")
    return df.select("doc_id", *carry, F.col("high_hits").cast("int"), F.col("network_hits").cast("int"), n.cast("int").alias("n_trackers"), score.alias("score"), score_label(score).alias("label"))


def category_counts(findings: DataFrame, only: str | None = None) -> DataFrame:
    """A1. (doc_id, category, findings)."""
    rows = findings.where(F.col("category") == only) if only else findings
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("findings"))


def attention_counts(findings: DataFrame) -> DataFrame:
    """A2. (doc_id, high, medium, low)."""
    return findings.groupBy("doc_id").agg(*(F.count_if(F.col("attention_level") == v).alias(v.lower()) for v in rules.LEVELS))


def pack_findings(findings: DataFrame) -> DataFrame:
    """A8. (doc_id, findings): findings back to an ordered array of structs, one per rule at most."""
    return findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_id", "category", "attention_level", "title", "evidence", "explanation"))).alias("findings"))


def site_risk_profile(analyses: DataFrame) -> DataFrame:
    """A9. (domain, label, scans, min_score, mean_score) by domain and label, by domain, and of all."""
    return analyses.rollup("domain", "label").agg(F.count("*").alias("scans"), F.min("score").alias("min_score"), F.round(F.avg("score"), 4).alias("mean_score"))


def declared_vs_observed(analyses: DataFrame, trackers: DataFrame) -> DataFrame:
    """J10. (doc_id, detected, n_trackers): a text that declares no sharing (false; null is not stated) on a page where
    trackers were seen."""
    df = analyses.select("doc_id", "declared_sharing").join(trackers.select("doc_id", "n_trackers"), "doc_id", "left")
    n = F.coalesce("n_trackers", F.lit(0))
    return df.select("doc_id", (F.col("declared_sharing").eqNullSafe(F.lit(False)) & (n > 0)).alias("detected"), n.cast("int").alias("n_trackers"))


def alert_flags(findings: DataFrame, alerts: DataFrame) -> DataFrame:
    """R4. (doc_id, needs_attention, should_warn, critical) of alerts (doc_id, detected, n_trackers) and findings."""
    per = findings.groupBy("doc_id").agg(F.count_if(F.col("attention_level") == "HIGH").alias("high"), F.bool_or((F.col("attention_level") == "HIGH") | F.col("category").isin("AI_USAGE", "DATA_SALE")).alias("critical"))
    df = alerts.join(per, "doc_id", "left")
    high = F.coalesce("high", F.lit(0))
    return df.select(
        "doc_id", (F.col("detected") | (high >= 1)).alias("needs_attention"), (F.col("detected") | (high >= 2) | (F.col("n_trackers") >= 3)).alias("should_warn"), F.coalesce("critical", F.lit(False)).alias("critical")
    )


def legal_document_gate(docs: DataFrame, phrases: list[str] = rules.LEGAL_PHRASES, controls: DataFrame | None = None, surface: str | None = None) -> DataFrame:
    """P13. Documents (doc_id, url, text) that are legal by address, by three phrases of the list in address or text,
    by consent controls (doc_id) on the page, or by their flag in the column ``surface`` (null: no)."""
    df = docs
    shown = F.lit(False)
    if controls is not None:
        df = df.join(controls.select("doc_id").distinct().withColumn("_c", F.lit(True)), "doc_id", "left")
        shown = F.coalesce("_c", F.lit(False))
    legal = F.col("url").rlike(rules.LEGAL_URL) | (present(F.concat_ws(" ", "url", "text"), phrases) >= 3) | shown | (F.coalesce(F.col(surface), F.lit(False)) if surface else F.lit(False))
    return df.where(legal).select(*docs.columns)


def verify_evidence(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """J7. (doc_id, rule_id, verbatim, uses): is the quote a substring of the document, and how often does the document
    use it. The repeat count is an aggregate joined back; then quotes are joined to texts by key, so texts are shuffled once."""
    uses = findings.groupBy("doc_id", "evidence").agg(F.count("*").alias("uses"))
    df = findings.select("doc_id", "rule_id", "evidence").join(uses, ["doc_id", "evidence"]).join(docs.select("doc_id", "text"), "doc_id", "left")
    return df.select("doc_id", "rule_id", F.coalesce(F.contains("text", "evidence"), F.lit(False)).alias("verbatim"), "uses")


CONTACT = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"


def disclosure_facts(docs: DataFrame) -> DataFrame:
    """R5. (doc_id, declared_sharing, contact, opt_out): sharing stated true or false, or null; first mail address; a
    right to opt out or object."""
    text = F.coalesce(F.col("text"), F.lit(""))
    denied = text.rlike("(?i)(do|does|will) not (sell or share|sell|share)")
    stated = text.rlike(r"(?i)(share|disclose|sell)s? .{0,60}(third part|advertising partner|partners)")
    mail = F.regexp_extract(text, CONTACT, 1)
    return docs.select("doc_id", F.when(denied, False).when(stated, True).alias("declared_sharing"), F.when(mail != "", mail).alias("contact"), text.rlike(r"(?i)opt[- ]out|right to object|to object").alias("opt_out"))


def opt_out_worklist(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """R7. (doc_id, recipient, letter): documents with an opt-out right or an AI or data sale finding."""
    risky = findings.where(F.col("category").isin("AI_USAGE", "DATA_SALE")).select("doc_id").distinct().withColumn("risky", F.lit(True))
    df = facts.join(risky, "doc_id", "left").where(F.col("opt_out") | F.coalesce("risky", F.lit(False)))
    to = F.coalesce("contact", F.lit("the privacy team"))
    return df.select("doc_id", to.alias("recipient"), F.format_string("To %s: I object to the processing of my data for purposes beyond the service (document %d).", to, F.col("doc_id")).alias("letter"))
