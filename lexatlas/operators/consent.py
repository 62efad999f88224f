"""Consent segments, controls and vendors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.text import collapse, hits, present
from .pages import source_like

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Segments(HTMLParser):
    """Elements that may hold a consent dialog: text, controls and place.

    An element counts by a name in its id or class, or by a dialog role, but not if it is a landmark of the page. It must
    hold ``least`` characters of text and a control, and be a dialog, have an attribute that speaks of consent, or lie above
    the page with a checkbox, a link or few controls. Styles are not computed: an element lies above the page unless its
    own style says static or relative."""

    def __init__(self, names: str, least: int):
        super().__init__()
        self.names, self.least, self.stack, self.done, self.at = re.compile(names, re.I), least, [], [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.at += 1
        name, kind, role = a.get("id", ""), a.get("class", ""), a.get("role", "").lower()
        dialog = role in ("dialog", "alertdialog") or a.get("aria-modal") == "true" or (tag == "dialog" and "open" in a)
        known = name.lower() in rules.CONSENT_IDS or rules.CONSENT_CLASS in kind.lower()
        landmark = tag in rules.LANDMARK_TAGS or role in rules.LANDMARK_ROLES
        control = tag == "button" or role == "button" or (tag == "input" and a.get("type") in ("button", "submit"))
        node = {
            "tag": tag, "start": self.at, "text": [], "controls": [], "control": control, "known": known, "loose": False,
            "hit": not landmark and (known or dialog or bool(self.names.search(f"{name} {kind}"))),
            "sure": dialog or any(re.search(rules.CONSENT_ATTRIBUTE, f"{k}={v}", re.I) for k, v in a.items()),
            "above": not re.search(r"position\s*:\s*(static|relative)", a.get("style", ""), re.I),
        }
        if (tag == "a" and "href" in a) or (tag == "input" and a.get("type") == "checkbox"):
            for x in self.stack:
                x["loose"] = True
        if control and tag == "input":
            for x in self.stack:
                x["controls"].append(a.get("value", ""))
        if tag not in VOID:
            self.stack.append(node)

    def handle_data(self, data):
        self.at += 1
        if self.stack and self.stack[-1]["tag"] in ("script", "style"):
            return
        for x in self.stack:
            if x["hit"] or x["control"]:
                x["text"].append(data)

    def handle_endtag(self, tag):
        if all(x["tag"] != tag for x in self.stack):
            return
        while self.stack:
            node = self.stack.pop()
            self.at += 1
            text = " ".join("".join(node["text"]).split())
            if node["control"]:
                for x in self.stack:
                    x["controls"].append(text)
            if node["hit"] and (node["known"] or self._dialog_like(node, text)):
                self.done.append((node["start"], self.at, text, node["controls"]))
            if node["tag"] == tag:
                break

    def _dialog_like(self, node, text):
        n = len(node["controls"])
        return len(text) >= self.least and n > 0 and (node["sure"] or (node["above"] and (node["loose"] or n <= 6)))


def consent_segments(pages: DataFrame, names: str = rules.CONSENT_NAMES, least: int = 30) -> DataFrame:
    """P17. (page_id, seg_start, seg_end, text, labels): elements named like a consent dialog or vendor, with text of at
    least ``least`` characters and an action control, but no landmarks (headers, navigation, footers, main parts). The
    containers of ``rules.CONSENT_IDS`` and ``rules.CONSENT_CLASS`` count as they are. Pages without such a word never
    reach the parser; null pages have no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page, html in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = _Segments(names, least)
                parser.feed(html)
                parser.handle_endtag(parser.stack[0]["tag"]) if parser.stack else None
                rows += [(page, *s) for s in sorted(parser.done)]
            yield pd.DataFrame(rows, columns=["page_id", "seg_start", "seg_end", "text", "labels"])

    named = pages.where(F.col("html").rlike(f"(?i){names}|{rules.CONSENT_CLASS}|role=.?(alert)?dialog|aria-modal")).select("page_id", "html")
    return named.mapInPandas(run, "page_id long, seg_start int, seg_end int, text string, labels array<string>")


def consent_signal_filter(segments: DataFrame) -> DataFrame:
    """P16. Segments with at least two marker hits, repeats counted."""
    return segments.where(hits(F.col("text"), rules.CONSENT_MARKERS) >= 2)


def outermost_segments(segments: DataFrame) -> DataFrame:
    """W7. Segments that lie in no other of their page, with their rank by text length, shortest first. Elements nest, so
    a segment is inside another exactly if one that started before it ends after it: a running maximum, not a join."""
    before = W.partitionBy("page_id").orderBy("seg_start", F.desc("seg_end")).rowsBetween(W.unboundedPreceding, -1)
    outer = segments.withColumn("_m", F.max("seg_end").over(before)).where(F.col("_m").isNull() | (F.col("_m") < F.col("seg_end"))).drop("_m")
    return outer.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.length("text"), "seg_start")))


def dedupe_prefix(segments: DataFrame, n: int = 50) -> DataFrame:
    """W6. Drops segments (page_id, pos, text, ...) whose first ``n`` characters occur in an earlier kept one of the page; a null
    text is an empty one, and that occurs in any. A table function reads the segments by page and position as a stream of rows
    (batches of Arrow would hold ten thousand texts at once); of a page only the kept texts are held, and no two of those
    begin alike."""

    class Fresh:
        def __init__(self):
            self.kept, self.heads = [], set()

        def eval(self, row: Row) -> Iterator[tuple]:
            text = row["text"] or ""
            head = text[:n]
            if head not in self.heads and not any(head in t for t in self.kept):
                self.kept.append(text)
                self.heads.add(head)
                yield tuple(row)

    fresh = F.udtf(Fresh, returnType=segments.schema, useArrow=False)
    return fresh(segments.asTable().partitionBy("page_id").orderBy("pos"))


def longest_banner(candidates: DataFrame) -> DataFrame:
    """W8. (page_id, kind, text) of (page_id, popup, iframe, vendor, plain_iframe, structural): popup or longer iframe
    text; vendor texts only while under 600 characters, plain iframes under 150, structural (first 3000) if longer;
    empty if it looks like source."""
    longer = lambda cond, text, kind, old: (F.when(cond & (F.length(text) > F.length(old[0])), text).otherwise(old[0]), F.when(cond & (F.length(text) > F.length(old[0])), kind).otherwise(old[1]))
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    best = (c("popup"), F.lit("popup"))
    best = longer(F.lit(True), c("iframe"), "iframe", best)
    best = longer(F.length(best[0]) < 600, c("vendor"), "vendor", best)
    best = longer(F.length(best[0]) < 150, c("plain_iframe"), "plain_iframe", best)
    best = longer(F.lit(True), F.left(c("structural"), F.lit(3000)), "structural", best)
    text = F.when(source_like(best[0]), "").otherwise(best[0])
    return candidates.select("page_id", best[1].alias("kind"), text.alias("text"))


def consent_controls(segments: DataFrame) -> DataFrame:
    """P18. (page_id, label, action) of segments (page_id, labels): consent labels as reject, manage or accept (reject
    before manage); empty and other labels dropped."""
    rows = segments.select("page_id", F.explode("labels").alias("raw")).withColumn("label", collapse("raw"))
    kept = rows.where((F.col("label") != "") & (F.col("label").rlike(rules.BUTTON_PHRASES) | F.col("label").rlike(rules.SHORT_BUTTONS)))
    return kept.select("page_id", "label", F.when(F.col("label").rlike(rules.REJECT_LABEL), "reject").when(F.col("label").rlike(rules.MANAGE_LABEL), "manage").otherwise("accept").alias("action"))


def page_resources(pages: DataFrame) -> DataFrame:
    """Resources of P19: (page_id, page_host, resource_url), the addresses of the frames and scripts of pages (page_id, url,
    html) as they are written, without relative ones, which name no host."""
    src = F.regexp_extract_all("html", F.lit(r"""(?is)<(?:iframe|script)\b[^>]*?\ssrc\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    return pages.select("page_id", urls.host(F.col("url")).alias("page_host"), F.explode(src).alias("resource_url"))


def cmp_vendors(resources: DataFrame, vendors: list[str] = rules.CONSENT_VENDORS) -> DataFrame:
    """P19. (vendor, pages, sites): consent vendors by the hosts of frames and scripts (page_id, page_host, resource_url)."""
    found = F.filter(F.array(*map(F.lit, vendors)), lambda v: F.contains(F.lower("resource_url"), v))
    return resources.select("page_id", "page_host", F.explode(found).alias("vendor")).groupBy("vendor").agg(F.count_distinct("page_id").alias("pages"), F.count_distinct("page_host").alias("sites"))


def dynamic_consent_flag(docs: DataFrame, markers: list[str] = rules.CONSENT_WORDS) -> DataFrame:
    """P15. Adds dynamic_consent: at least two of the markers occur."""
    return docs.withColumn("dynamic_consent", present(F.col("text"), markers) >= 2)


#: Kinds of data that a "take all" choice may cover.
DATA_KINDS = {"analytics": "analytics|measure", "advertising": "advertis", "location": "geolocation|location", "identifiers": "identifier|ip address", "third_parties": "third[- ]part"}


def cookie_choice_breakdown(controls: DataFrame, docs: DataFrame, kinds: dict[str, str] = DATA_KINDS) -> DataFrame:
    """R6. Per page with controls: labels of the essential and the all choice, kinds of data that the text names, and
    the risk of taking all (HIGH from three kinds or advertising with third parties, MEDIUM from one, else LOW)."""
    labels = controls.groupBy("page_id").agg(
        F.min(F.when(F.col("action") == "accept", F.col("label"))).alias("all_label"), F.min(F.when(F.col("action") != "accept", F.col("label"))).alias("essential_label")
    )
    found = F.filter(F.array(*(F.when(F.col("text").rlike("(?i)" + p), k) for k, p in kinds.items())), lambda k: k.isNotNull())
    rows = labels.join(docs.select("page_id", found.alias("kinds")), "page_id", "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    high = (F.size("kinds") >= 3) | (F.array_contains("kinds", "advertising") & F.array_contains("kinds", "third_parties"))
    risk = F.when(high, "HIGH").when(F.size("kinds") >= 1, "MEDIUM").otherwise("LOW")
    return rows.select("page_id", "essential_label", "all_label", F.array_join(F.array_sort("kinds"), ",").alias("data_kinds"), risk.alias("all_risk"))
