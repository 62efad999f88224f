"""Inputs that the registered queries derive from the given tables, in SQL that Spark and DuckDB read alike.

The given prose has no legal words, so clauses, scans, fetches and resources are derived from whole tables by
deterministic expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .sources.crawl import spread

#: Given tables of long texts.
WITH_TEXTS = ("documents", "pages")
CLAUSES = [
    "We share personal data with advertising partners and third parties.",
    "Your subscription will automatically renew each month.",
    "We use cookies and analytics for tracking.",
    "No refunds are given for any purchase.",
    "We may terminate or suspend your account at any time.",
    "You grant us a perpetual license to user content.",
    "We may train our models with your data using machine learning.",
    "All disputes are subject to mandatory arbitration.",
    "You may opt out and contact privacy@example.com to object.",
    "We do not sell or share your information. You can manage cookies or accept all.",
]


def _clause(key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN ' {c}'" for i, c in enumerate(CLAUSES)) + " ELSE '' END"


HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
SIX = "(SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5) n"
SEC = "CAST(floor(value / 10) AS BIGINT)"

#: name -> (given tables, SQL)
DERIVED: dict[str, tuple[tuple[str, ...], str]] = {
    "policy_docs": (("documents",), f"""
        SELECT doc_id, 'site' || CAST(doc_id % 50 AS STRING) || '.example.com' AS domain,
          'https://site' || CAST(doc_id % 50 AS STRING) || '.example.com/' || CASE WHEN doc_id % 4 = 0 THEN 'privacy' ELSE 'docs' END || '/' || CAST(doc_id AS STRING) AS url,
          text || {_clause('doc_id % 12')} AS text, lang, md5(text || {_clause('doc_id % 12')}) AS content_hash, 6 * doc_id + 3 AS ts FROM {{documents}}"""),
    "versions": (("documents",), f"""
        SELECT 'site' || CAST(doc_id AS STRING) AS domain, 6 * doc_id + v.i AS created_at, v.i AS version_no,
          text || {_clause('CAST((doc_id + floor(v.i / 2)) % 10 AS BIGINT)')} AS text,
          md5(text || {_clause('CAST((doc_id + floor(v.i / 2)) % 10 AS BIGINT)')}) AS content_hash
        FROM {{documents}} CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2) v"""),
    "scans": (("events",), f"""
        SELECT event_id AS scan_id, CAST(user_id AS STRING) AS client_id,
          'https://app.example.com/' || event_type || CASE event_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '#top' ELSE '' END AS url,
          md5(CAST({SEC} AS STRING)) AS content_hash, ts FROM {{events}}"""),
    "resources": (("pages",), f"""
        SELECT page_id, {HOST} AS page_host, 'https://' || CASE (page_id * 7 + n.i) % 8
          WHEN 0 THEN 'www.google-analytics.com' WHEN 1 THEN 'doubleclick.net' WHEN 2 THEN 'ads.criteo.com:8080' WHEN 3 THEN 'notdoubleclick.net'
          WHEN 4 THEN {HOST} WHEN 5 THEN 'cdn.cookielaw.org' WHEN 6 THEN 'x.y.hotjar.com' ELSE 'segment.io' END || '/x.js' AS resource_url
        FROM {{pages}} CROSS JOIN {SIX}"""),
    "legal_links": (("pages",), f"""
        SELECT page_id, url AS page_url, n.i AS pos, {{own}} || CASE (page_id + n.i) % 9
          WHEN 0 THEN '/en/privacy-policy/339282' WHEN 1 THEN '/de/datenschutz/339282' WHEN 2 THEN '/p/cookies-12/1016' WHEN 3 THEN '/terms?utm_source=feed'
          WHEN 4 THEN '/terms/' WHEN 5 THEN '/small-flower-cookie-12-oz/1016233601' WHEN 6 THEN '/' WHEN 7 THEN '/assets/cookie-consent.min.js' ELSE '/about' END AS href,
          CASE (page_id + n.i) % 5 WHEN 0 THEN 'Privacy policy' WHEN 1 THEN 'Terms' WHEN 2 THEN 'Cookie settings' ELSE 'Read more' END AS label
        FROM {{pages}} CROSS JOIN {SIX}""".replace("{own}", "regexp_extract(url, '^(https?://[^/?#]*)', 1)")),
    "sitemap": (("pages",), f"""
        SELECT {HOST} AS site, page_id * 10 + n.i AS pos, 'https://' || {HOST} || CASE (page_id + n.i) % 7
          WHEN 0 THEN '/illegale-schatzsuche' WHEN 1 THEN '/privacy-policy' WHEN 2 THEN '/legal/terms%20of%20use' WHEN 3 THEN '/news' WHEN 4 THEN '/cookie-notice?x=terms'
          WHEN 5 THEN '/usloviya' ELSE '/blog/gdpr' END || '/' || CAST(page_id AS STRING) AS url
        FROM {{pages}} CROSS JOIN {SIX}"""),
    "fetches": (("pages",), """
        SELECT page_id, url, CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status,
          CASE page_id % 9 WHEN 2 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
          CASE page_id % 9 WHEN 3 THEN '' WHEN 4 THEN '<body><p>This page is over its quota limits today</p></body>'
            WHEN 5 THEN '<body>' || repeat('<div></div>', 250) || 'thin</body>'
            WHEN 6 THEN '<body><pre>' || repeat('var a = function() 1; const b = require(0); let c = 2; window.d = 3; ', 8) || '</pre></body>' ELSE html END AS html
        FROM {pages}"""),
    "consent_pages": (("pages",), """
        SELECT page_id, url, replace(html, '</body>', CASE WHEN page_id % 3 = 0 THEN '<div class="modal-wrap">' ELSE '' END ||
          '<div id="cookie-box">We and our partners store cookies on page ' || CAST(page_id AS STRING) || '. You may manage cookies at any time.<button>Accept all</button>' ||
          CASE WHEN page_id % 2 = 0 THEN '<button>Reject all</button>' ELSE '' END || '<button>Cookie settings</button></div>' ||
          CASE WHEN page_id % 3 = 0 THEN '</div>' ELSE '' END || '</body>') AS html FROM {pages}"""),
    "controls": (("pages",), f"""
        SELECT page_id, n.i AS pos, CASE (page_id + n.i) % 8 WHEN 0 THEN 'Accept all' WHEN 1 THEN 'Reject all' WHEN 2 THEN ' Manage  cookies ' WHEN 3 THEN 'OK'
          WHEN 4 THEN 'Read more' WHEN 5 THEN 'Decline or manage cookies' WHEN 6 THEN '' ELSE 'settings' END AS label FROM {{pages}} CROSS JOIN {SIX}"""),
    "segments": (("documents",), f"""
        SELECT CAST(floor(doc_id / 4) AS BIGINT) AS page_id, CAST(doc_id % 4 AS INT) AS pos, text || {_clause('doc_id % 12')} AS text,
          CAST(CASE doc_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 60 ELSE 70 END AS INT) AS seg_start, CAST(CASE doc_id % 4 WHEN 0 THEN 50 WHEN 1 THEN 30 WHEN 2 THEN 90 ELSE 80 + doc_id % 3 * 10 END AS INT) AS seg_end
        FROM {{documents}}"""),
    "cascades": (("documents",), """
        SELECT doc_id AS page_id, 0 AS pos, text FROM {documents}
        UNION ALL SELECT d.doc_id AS page_id, 1 AS pos, d.text || n.text AS text FROM {documents} d JOIN (SELECT doc_id - 1 AS doc_id, text FROM {documents}) n ON n.doc_id = d.doc_id
        UNION ALL SELECT doc_id - 1 AS page_id, 2 AS pos, text FROM {documents}"""),
    "analyses": (("documents", "labels"), """
        SELECT md5(CAST(d.doc_id AS STRING)) AS analysis_id, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 'c' || CAST(d.doc_id % 40 AS STRING) END AS client_id,
          'https://site' || CAST(d.doc_id % 50 AS STRING) || '.example.com/docs/' || CAST(d.doc_id AS STRING) AS url, 'site' || CAST(d.doc_id % 50 AS STRING) || '.example.com' AS domain,
          CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST((d.n_chars + l.quality) % 101 AS INT) END AS safety_score, CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'kept' END AS safety_prediction,
          CASE WHEN d.doc_id % 6 = 0 THEN NULL ELSE md5(d.text) END AS content_hash, d.doc_id % 97 AS created_at
        FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""),
    "blocks": (("documents",), """
        SELECT CAST(floor(doc_id / 5) AS BIGINT) AS doc_id, CAST(doc_id % 5 AS INT) AS block_no, text FROM {documents}"""),
    "quotes": (("documents",), """
        SELECT doc_id, CAST(2 AS BIGINT) AS rule_id, split_part(text, '. ', 2) AS evidence FROM {documents}
        UNION ALL SELECT d.doc_id, CAST(3 AS BIGINT) AS rule_id, p.evidence FROM {documents} d
        JOIN (SELECT doc_id + 1 AS doc_id, split_part(text, '. ', 2) AS evidence FROM {documents}) p ON p.doc_id = d.doc_id"""),
    "own_quotes": (("documents",), """
        SELECT doc_id, CAST(0 AS BIGINT) AS rule_id, split_part(text, '. ', 1) AS evidence FROM {documents}
        UNION ALL SELECT d.doc_id, CAST(1 AS BIGINT) AS rule_id, n.evidence FROM {documents} d
        JOIN (SELECT doc_id - 1 AS doc_id, split_part(text, '. ', 1) AS evidence FROM {documents}) n ON n.doc_id = d.doc_id"""),
    "provider_log": (("events",), """
        SELECT event_id AS id, 'p' || CAST(user_id % 3 AS STRING) AS provider, CASE event_id % 6 WHEN 0 THEN 'Error 429: slow down' WHEN 1 THEN 'Rate limit reached' WHEN 2 THEN 'model_not_found: x'
          WHEN 3 THEN 'You do not have access' WHEN 4 THEN NULL ELSE 'connection reset' END AS message FROM {events}"""),
    "questions": (("conversations",), """
        SELECT conv_id * 100 + turn AS id, text, turn % 2 = 0 AS has_document FROM {conversations}"""),
    "payloads": (("events",), """
        SELECT CAST(user_id AS STRING) AS page, event_id AS ts, CASE event_id % 4 WHEN 0 THEN 'thin' WHEN 1 THEN 'No readable text was found on this page.' ELSE event_type || repeat(' word', CAST(event_id % 50 AS INT)) END AS text FROM {events}"""),
    "raw_outputs": (("documents",), """
        SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'not json' WHEN 1 THEN '{"domain":"a","summary":"s","findings":[]}'
          WHEN 2 THEN '{"domain":"a","safety_score":130,"summary":"s","findings":[]}'
          WHEN 3 THEN '{"domain":"a","safety_score":30,"summary":"s","findings":[{"category":"NOPE","attention_level":"HIGH","title":"t","section":"x","evidence":"e","explanation":"y"}]}'
          ELSE '{"domain":"a","safety_score":' || CAST(doc_id % 100 AS STRING) || ',"summary":"s","findings":[{"category":"MONEY","attention_level":"LOW","title":"t","section":"x","evidence":"e","explanation":"y"}]}' END AS output
        FROM {documents}""".replace('{"', '{{"').replace('"}', '"}}').replace(':[]}', ':[]}}').replace('"}}]}', '"}}]}}')),
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    given, sql = DERIVED[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in given}
    return spark.sql(sql, **{t: spread(df) if t in WITH_TEXTS else df for t, df in tables.items()})


def cte(*names: str) -> str:
    """The derived tables as common table expressions for DuckDB."""
    parts = []
    for n in names:
        given, sql = DERIVED[n]
        parts.append(f"{n} AS ({sql.format(**{t: t for t in given})})")
    return "WITH " + ", ".join(parts)
