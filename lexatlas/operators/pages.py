"""Fetched pages to clean documents."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.markup import DROPPED, body_text
from ..functions.payload import payloads
from ..functions.scan import carried
from ..functions.shared import written
from ..functions.text import BLANK, chars, collapse, decode_entities, hits, once
from ..languages import SAMPLES, Guesser

QUOTA = "(?i)quota limits|exceeding recaptcha"


def strip_tags(html: Column, drop: tuple[str, ...] = DROPPED) -> Column:
    """The body's text without the elements ``drop``, common character references decoded, blanks collapsed."""
    return collapse(decode_entities(body_text(html, drop)))


def main_text(pages: DataFrame) -> DataFrame:
    """P5. (page_id, url, text): body text without scripts, styles, navigation, headers, footers, drawings; elements end
    where the document tree ends them."""
    return pages.select("page_id", "url", strip_tags(F.col("html")).alias("text"))


def decode_bodies(raw: DataFrame) -> DataFrame:
    """S2. (page_id, charset, text) from (page_id, content_type, body): charset of the HTTP header, else of a meta tag in
    the first 2048 bytes, else utf-8; a label that no codec has is read as utf-8."""
    head = F.decode(F.substring("body", 1, 2048), "ISO-8859-1")
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    label = F.coalesce(
        found(F.coalesce("content_type", F.lit("")), r"(?i)charset=([\w-]+)"), found(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)"),
        found(head, r"(?i)<meta[^>]+content=[\"'][^\"']*charset=([\w-]+)"), F.lit("utf-8"),
    )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import codecs

        for pdf in batches:
            labels, texts = [], []
            for name, body in zip(pdf["charset"], pdf["body"], strict=True):
                try:
                    codecs.lookup(name)
                except LookupError:
                    name = "utf-8"
                labels.append(name)
                texts.append(None if body is None else bytes(body).decode(name, "replace"))
            yield pd.DataFrame({"page_id": pdf["page_id"], "charset": labels, "text": texts})

    return raw.select("page_id", F.lower(label).alias("charset"), "body").mapInPandas(decode, "page_id long, charset string, text string")


def source_like(text: Column) -> Column:
    n = hits(text, rules.CODE_TOKENS)
    return (n >= 6) & (n / F.greatest(F.length(text), F.lit(1)) > 0.002)


def fetch_outcomes(pages: DataFrame) -> DataFrame:
    """S8. (page_id, outcome, retryable): the first of http_error, content_type, quota_page, js_rendered, source_code,
    too_thin that applies, else ok."""
    rows = pages.withColumn("_text", strip_tags(F.coalesce("html", F.lit(""))))
    return rows.select("page_id", outcome_of(F.col("_text")).alias("outcome"), F.coalesce(F.col("status").isin(403, 429, 503), F.lit(False)).alias("retryable"))


def outcome_of(text: Column) -> Column:
    """S8's outcome of a page (status, content_type, html) with this main text."""
    thin = F.length(text) < 200
    return (
        F.when(F.col("status") >= 400, "http_error")
        .when(~F.coalesce("content_type", F.lit("text/html")).rlike("(?i)html"), "content_type")
        .when(text.rlike(QUOTA), "quota_page")
        .when((F.length(F.coalesce("html", F.lit(""))) >= 2000) & thin, "js_rendered")
        .when(thin, "too_thin")
        .when(source_like(text), "source_code")
        .otherwise("ok")
    )


def outcome_histogram(outcomes: DataFrame, links: DataFrame) -> DataFrame:
    """A6. Per origin page: links, failures by reason, and whether all links failed as rendered by script with no text.
    outcomes: (page_id, outcome); links: (origin_page, page_id)."""
    kinds = ("http_error", "content_type", "quota_page", "js_rendered", "too_thin", "source_code", "ok")
    return links.join(outcomes, "page_id").groupBy("origin_page").agg(
        F.count("*").alias("links"), *(F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds), F.every(F.col("outcome") == "js_rendered").alias("js_suspect")
    )


def rendered_text_choice(pages: DataFrame, rendered: DataFrame) -> DataFrame:
    """P6. (page_id, text, chosen): the static text; if under 200 characters the embedded payload, then the rendered
    text; a rendered text that is thin when cleaned but has 1200 raw characters is kept raw."""
    df = pages.select("page_id", "static_text", "payload_text").join(rendered.select("page_id", "rendered_text"), "page_id", "left")
    return df.select("page_id", *chosen_text())


def chosen_text() -> tuple[Column, Column]:
    """P6's text and chosen of a page (static_text, payload_text, rendered_text)."""
    raw = F.col("rendered_text")
    clean = collapse(strip_noise(raw))
    shown = F.when((F.length(clean) < 200) & (F.length(raw) >= 1200), raw).otherwise(clean)
    chosen = F.when(F.length("static_text") >= 200, "static").when(F.length("payload_text") >= 200, "payload").when(F.length(shown) > 0, "rendered").otherwise("static")
    text = F.when(chosen == "payload", F.col("payload_text")).when(chosen == "rendered", shown).otherwise(F.col("static_text"))
    return text.alias("text"), chosen.alias("chosen")


def payload_prose(pages: DataFrame, least: int = 200) -> DataFrame:
    """P7. (page_id, text): strings of at least ``least`` characters with a blank that scripts carry as values of JSON, at any
    depth and however often encoded, or as quoted literals, joined in order, without markup and the payload's own marks;
    source-like or short results are dropped."""
    return pages.select("page_id", payload_text(F.col("html"), least).alias("text")).where(is_payload_text(F.col("text"), least))


def is_payload_text(text: Column, least: int = 200) -> Column:
    return (F.length(text) >= least) & ~source_like(text)


def payload_text(html: Column, least: int = 200) -> Column:
    """P7's text, before it is seen whether it is short or source-like; a generator, for ``select``."""
    clean = lambda s: collapse(F.regexp_replace(strip_noise(s, rules.PAYLOAD_MARKS), "<[^>]*>", " "))
    prose = F.filter(F.transform(payloads(html, least), clean), lambda s: (F.length(s) >= least) & s.contains(" "))
    return once(F.array_join(prose, " "))


def strip_noise(text: Column, patterns: list[str] = rules.NOISE_PATTERNS) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, " ")
    return text


def strip_boilerplate(docs: DataFrame, patterns: list[str] = rules.NOISE_PATTERNS) -> DataFrame:
    """P8. Removes badge, certificate, captcha and review phrases, then collapses blanks."""
    return docs.withColumn("text", collapse(strip_noise(F.col("text"), patterns)))


def drop_source_like(docs: DataFrame) -> DataFrame:
    """P9. Drops texts that look like program source."""
    return docs.where(~F.coalesce(source_like(F.col("text")), F.lit(False)))


def lettered(text: Column) -> Column:
    """The words of a text, cut at blanks, that hold a letter."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w.rlike(r"\p{L}"))


def prose_quality(docs: DataFrame, limit: int | None = 6000) -> DataFrame:
    """P10. Adds prose_score 0..1 of the first ``limit`` characters, or of the whole text with ``None``: letters, symbols,
    sentence ends and lengths, digits and variety of words."""
    s, text = F.col("_s"), F.coalesce("text", F.lit(""))
    counted = docs.withColumn("_s", text if limit is None else F.left(text, F.lit(limit))).withColumns({
        "_letters": chars(s, r"[\p{L}\p{M}]"), "_digits": hits(s, r"\p{N}"),
        "_symbols": F.length(s) - chars(s, r"[\p{L}\p{M}\p{N}\s\x{00a0}\x{feff}\x{2028}\x{2029}\x{3000}.,;:!?'\x22()\[\]{}\-–—/\\]"),
        "_ends": hits(s, r"[.!?…。！？।؟۔](?<![0-9][.!?…])"), "_words": lettered(F.lower("_s")), "_total": F.length(s),
    })
    total, letters, digits, symbols, ends, words = (F.col(f"_{c}") for c in ("total", "letters", "digits", "symbols", "ends", "words"))
    variety = F.when(F.size(words) >= 40, F.size(F.array_distinct(words)) / F.size(words)).otherwise(1.0)
    mean = (letters + digits) / F.greatest(ends, F.lit(1))
    step = lambda c, *levels: F.coalesce(*(F.when(c(x), y) for x, y in levels), F.lit(0.0))
    score = (
        step(lambda x: letters / total >= x, (0.55, 0.45), (0.4, 0.3), (0.25, 0.1))
        + step(lambda x: symbols / total <= x, (0.02, 0.25), (0.05, 0.15), (0.1, 0.05))
        + F.when(ends >= 3, 0.2).when(ends >= 1, 0.1).otherwise(-0.3)
        + F.when(ends < 1, 0.0).when(mean >= 45, 0.15).when(mean >= 20, 0.08).otherwise(0.0)
        - F.when(digits / F.greatest(letters + digits, F.lit(1)) > 0.08, 0.2).otherwise(0.0)
        - F.when(variety < 0.35, 0.15).otherwise(0.0)
        + F.when(letters > 400, 0.05).otherwise(0.0)
    )
    scored = F.when(total < 50, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))
    return counted.select(*(c for c in docs.columns if c != "prose_score"), once(scored).alias("prose_score"))


def prose_gate(docs: DataFrame, lo: float = 0.4, hi: float = 0.55) -> DataFrame:
    """P11. Keeps texts of 300 characters that are not source: kind 'prose' from ``hi``, 'short_legal' from ``lo``."""
    scored = docs if "prose_score" in docs.columns else prose_quality(docs)
    kept = scored.where((F.length("text") >= 300) & ~source_like(F.col("text")) & (F.col("prose_score") >= lo))
    return kept.withColumn("kind", F.when(F.col("prose_score") >= hi, "prose").otherwise("short_legal"))


def vocabulary_variety(docs: DataFrame, least: int = 40) -> DataFrame:
    """A10. (doc_id, tokens, variety): distinct lower-case tokens over tokens; 1 below ``least`` tokens."""
    return with_variety(docs.select("doc_id", "text"), least).select("doc_id", "tokens", "variety")


def with_variety(docs: DataFrame, least: int = 40) -> DataFrame:
    """A10's tokens and variety, added to the documents."""
    words = F.col("_words")
    n = F.size(words)
    found = docs.withColumn("_words", lettered(F.lower(F.coalesce("text", F.lit("")))))
    return found.select(*docs.columns, n.cast("long").alias("tokens"), F.when(n >= least, F.round(F.size(F.array_distinct(words)) / n, 6)).otherwise(1.0).alias("variety"))


def detect_language(docs: DataFrame, samples: Mapping[str, str] = SAMPLES) -> DataFrame:
    """P21. (doc_id, detected): script ranges decide first; the other texts take the language whose character n-grams, as
    counted in ``samples``, make them most likely (ties: en, then alphabetical; en where there are no letters). Whole texts
    are scored, in one pass of a Pandas function; those with a decided script do not reach it."""
    return with_language(docs.select("doc_id", "text"), samples).select("doc_id", "detected")


def with_language(docs: DataFrame, samples: Mapping[str, str] = SAMPLES) -> DataFrame:
    """P21's detected, added to the documents."""

    @F.pandas_udf("string")
    def guessed(texts: pd.Series) -> pd.Series:
        return texts.map(_guesser(tuple(samples.items())).guess, na_action="ignore")

    text = F.col("_text")
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumn("_latin", F.when(~text.rlike("|".join(pattern for _, pattern in rules.SCRIPTS)), text))  # one search spares most texts the ladder
    ladder = F.when(F.col("_latin").isNotNull(), guessed("_latin"))
    for lang, pattern in rules.SCRIPTS:
        ladder = ladder.when(text.rlike(pattern) & (text.rlike(r"[\x{0400}-\x{04ff}]") if lang in ("uk", "ru") else F.lit(True)), lang)
    return rows.select(*docs.columns, ladder.otherwise(guessed(text)).alias("detected"))


@functools.cache
def _guesser(samples: tuple[tuple[str, str], ...]) -> Guesser:
    return Guesser(dict(samples))


def dedupe_text(docs: DataFrame) -> DataFrame:
    """W5. The first document (smallest doc_id) of each collapsed, lower-cased text. Only keys and digests are grouped;
    the kept ids are joined back."""
    keys = docs.select("doc_id", F.sha2(F.lower(collapse("text")), 256).alias("signature"))
    return docs.join(keys.groupBy("signature").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")


def usable_text_filter(payloads: DataFrame, fallbacks: list[str]) -> DataFrame:
    """P22. (page, ts, text, from_cache): payloads under 30 characters or equal to a fallback text are replaced by the
    page's latest good one before them (of equal times by the text's digest), or dropped if there is none. The latest good
    one is found on digests, in ranges of page and time; texts meet by page, time and digest, and only those needed."""
    good = F.coalesce((F.length("text") >= 30) & ~F.col("text").isin(*fallbacks), F.lit(False))
    rows = payloads.select("page", "ts", "text", good.alias("good"), F.sha2("text", 256).alias("h"))
    keys = carried(rows.drop("text"), ["page"], ["ts", "h"], {"src": (F.when(F.col("good"), F.struct(F.col("ts").alias("ts"), F.col("h").alias("h"))), False)})
    thin = written(keys.where("not good and src is not null").select("page", "ts", F.col("src.ts").alias("src_ts"), F.col("src.h").alias("src_h")))
    needed = thin.select("page", F.col("src_ts").alias("ts"), F.col("src_h").alias("h")).distinct()
    texts = rows.where("good").join(needed, ["page", "ts", "h"], "left_semi").groupBy("page", F.col("ts").alias("src_ts"), F.col("h").alias("src_h")).agg(F.any_value("text").alias("text"))
    cached = thin.join(texts, ["page", "src_ts", "src_h"]).select("page", "ts", "text", F.lit(True).alias("from_cache"))
    return rows.where("good").select("page", "ts", "text", F.lit(False).alias("from_cache")).unionByName(cached)


def best_candidate(samples: DataFrame) -> DataFrame:
    """A7. Per page the longest text of its samples (then the first), and flags that any sample had."""
    return samples.groupBy("page_id").agg(
        F.max_by("text", F.struct(F.length("text"), -F.col("sample"))).alias("text"), F.bool_or("legal_surface").alias("legal_surface"), F.bool_or("js_suspect").alias("js_suspect"), F.count("*").alias("samples")
    )
