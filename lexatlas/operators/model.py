"""The data flow around batches of model calls. The calls themselves are the caller's: a provider takes a pandas batch of
(id, input) and returns (id, output) for the rows that it can answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.shared import written
from .risk import score_label

Provider = Callable[[pd.DataFrame], pd.DataFrame]


def conversation_messages(turns: DataFrame, system: str | None = None, context: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """L1. (conv_id, messages): turns in order as (role, content); roles other than user are assistant unless system; empty
    turns dropped. ``system`` comes first, then the text of ``context`` (conv_id, text) as a second system message; the text
    of ``questions`` (conv_id, text) comes last. Conversations of any of the three tables get a row."""
    role = F.when(F.lower("role").isin("user", "system"), F.lower("role")).otherwise("assistant")
    rows = turns.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("conv_id", "turn", role.alias("role"), F.trim("text").alias("content"))
    extra = lambda df, n, role, text: df.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("conv_id", F.lit(n).alias("part"), F.lit(0).alias("turn"), F.lit(role).alias("role"), text.alias("content"))
    rows = rows.select("conv_id", F.lit(2).alias("part"), "turn", "role", "content")
    if context is not None:
        rows = rows.unionByName(extra(context, 1, "system", F.concat(F.lit("DOCUMENT CONTEXT:\n"), "text")))
    if questions is not None:
        rows = rows.unionByName(extra(questions, 3, "user", F.col("text")))
    if system:
        rows = rows.unionByName(extra(rows.select("conv_id", F.lit(system).alias("text")).distinct(), 0, "system", F.col("text")))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("part", "turn", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(packed.alias("messages"))


def analysis_inputs(docs: DataFrame) -> DataFrame:
    """L2. (doc_id, input): language, original text, and the translation if there is one that differs."""
    other = F.when((F.trim("translated_text") != "") & (F.trim("translated_text") != F.trim("text")), F.concat(F.lit("TRANSLATION:\n"), F.trim("translated_text")))
    return docs.select("doc_id", F.concat_ws("\n\n", F.concat(F.lit("LANGUAGE: "), F.coalesce("lang", F.lit("unknown"))), F.concat(F.lit("TEXT:\n"), F.trim("text")), other).alias("input"))


def enrich(docs: DataFrame, providers: Mapping[str, Provider], default: str | None = None, calls: int | None = None) -> DataFrame:
    """L3. (id, output, source): the first provider that returns a row for an id wins; then ``default`` with source
    'rules'. Each provider sees only what those before it missed; ``calls`` bounds the tasks that call one at a time."""
    left, done = docs.select("id", "input"), None
    for name, provider in providers.items():

        def run(batches: Iterator[pd.DataFrame], provider: Provider = provider) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = provider(pdf)
                yield out[["id", "output"]].dropna()

        asked = left.repartition(calls, "id") if calls else left
        got = asked.mapInPandas(run, "id long, output string").withColumn("source", F.lit(name))
        got = written(got)  # answers are not asked for twice, whatever executor is lost
        done = got if done is None else done.unionByName(got)
        left = left.join(got.select("id"), "id", "left_anti")
    rest = left.select("id", F.lit(default).alias("output"), F.lit("rules").alias("source"))
    return rest if done is None else done.unionByName(rest)


def classify_documents(docs: DataFrame, providers: Mapping[str, Provider], undecided: bool = True) -> DataFrame:
    """L6. (id, legal, source): 'true' or 'false' by the chain on the first 4000 characters, else ``undecided``."""
    heads = docs.select("id", F.left("text", F.lit(4000)).alias("input"))
    out = enrich(heads, providers)
    return out.select("id", F.coalesce(F.when(F.lower("output").isin("true", "false"), F.lower("output") == "true"), F.lit(undecided)).alias("legal"), "source")


# Names and types of an answer's fields.
RESPONSE = (
    "url string, domain string, safety_score int, safety_prediction string, summary string, "
    "findings array<struct<category string, attention_level string, title string, section string, evidence string, explanation string>>, "
    "analysis_available boolean, analysis_error string, analysis_source string, declared_third_party_sharing boolean, detected_trackers array<string>, "
    "hypocrisy_alert struct<detected boolean, title string, message string, trackers array<string>>, privacy_email string, can_opt_out boolean, "
    "semantic_diff struct<has_changed boolean, previous_date string, changes array<struct<type string, text string>>>, "
    "cookie_breakdown struct<essential struct<label string, data_collected array<string>, risk_level string>, all_optional struct<label string, data_collected array<string>, risk_level string>>"
)
#: Values of fields that an answer may leave out.
DEFAULTS = {"analysis_available": True, "analysis_source": "ai", "can_opt_out": False}


def parse_responses(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """L4. Typed results of (id, output) with all fields of ``RESPONSE``, and (id, reason) of the rejected: not JSON, missing fields, a score beyond 0..100,
    or a category or level that does not exist."""
    df = raw.withColumn("r", F.from_json("output", RESPONSE + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    bad_finding = F.exists("r.findings", lambda f: ~F.coalesce(f["category"].isin(*rules.CATEGORIES), F.lit(False)) | ~F.coalesce(f["attention_level"].isin(*rules.LEVELS), F.lit(False)) | f["title"].isNull() | f["evidence"].isNull())
    reason = (
        F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), "not_json")
        .when(F.col("r.safety_score").isNull() | F.col("r.summary").isNull() | F.col("r.findings").isNull(), "missing_field")
        .when(~F.col("r.safety_score").between(0, 100), "score_range")
        .when(bad_finding, "bad_finding")
    )
    df = df.withColumn("reason", reason)
    good = df.where("reason is null").select("id", "r.*").drop("_bad").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    good = good.withColumn("safety_prediction", F.coalesce("safety_prediction", score_label(F.col("safety_score"))))
    good = good.withColumn("detected_trackers", F.coalesce("detected_trackers", F.array().cast("array<string>")))
    return good, df.where("reason is not null").select("id", "reason")


def provider_errors(log: DataFrame) -> DataFrame:
    """L5. (provider, kind, errors): rate_limit, model_unavailable or other."""
    low = F.lower(F.coalesce("message", F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    kind = F.when(any_of(rules.RATE_LIMIT_WORDS), "rate_limit").when(any_of(rules.UNAVAILABLE_WORDS), "model_unavailable").otherwise("other")
    return log.groupBy("provider", kind.alias("kind")).agg(F.count("*").alias("errors"))


def localized_messages(requests: DataFrame, no_document: Mapping[str, str] = rules.NO_DOCUMENT, no_provider: Mapping[str, str] = rules.NO_PROVIDER) -> DataFrame:
    """J8. (id, message) of requests (id, lang, has_document): by language, default English, from the table for requests
    with or without a document. The tables are constants of a few languages, so they are maps, not joins."""
    table = lambda m: F.create_map(*(F.lit(x) for pair in m.items() for x in pair))
    pick = lambda m: F.coalesce(F.try_element_at(table(m), F.coalesce("lang", F.lit("en"))), F.lit(m["en"]))
    return requests.select("id", F.when(F.col("has_document"), pick(no_provider)).otherwise(pick(no_document)).alias("message"))


def fallback_answers(questions: DataFrame) -> DataFrame:
    """L7. (id, answer, evidence_quote) of questions (id, text, has_document): the default answer in the question's
    language, without a quote."""
    from .pages import detect_language

    found = detect_language(questions.withColumnRenamed("id", "doc_id")).select(F.col("doc_id").alias("id"), F.col("detected").alias("lang"))
    return localized_messages(questions.select("id", "has_document").join(found, "id")).select("id", F.col("message").alias("answer"), F.lit(None).cast("string").alias("evidence_quote"))


def answer_quotes(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """L8. (id, answer, evidence_quote) of answers (id, doc_id, answer, quote): quotes that are not verbatim become null."""
    df = answers.join(docs.select("doc_id", "text"), "doc_id", "left")
    return df.select("id", "answer", F.when(F.contains("text", "quote"), F.col("quote")).alias("evidence_quote"))


def reuse_translations(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J9. Chunks (doc_id, chunk_no, chunk, target) with the cached translation of the same text and target, and those still
    to do. Joined on digests, so texts of the cache are not shuffled by content."""
    key = F.sha2(F.col("chunk"), 256)
    keyed, known = chunks.withColumn("key", key), cache.withColumn("key", key).groupBy("key", "target").agg(F.min("translated").alias("translated"))
    return keyed.join(known, ["key", "target"]).select("doc_id", "chunk_no", "translated"), keyed.join(known.select("key", "target"), ["key", "target"], "left_anti").drop("key")


def language_mix(chunks: DataFrame) -> DataFrame:
    """A12. (doc_id, detected, any_translated): first known language in chunk order, and whether any was translated."""
    first = F.min(F.when(F.col("detected").isNotNull(), F.struct("chunk_no", "detected")))
    return chunks.groupBy("doc_id").agg(first["detected"].alias("detected"), F.coalesce(F.bool_or("translated"), F.lit(False)).alias("any_translated"))
