"""Registered queries of the policy-corpus jobs and their DuckDB twins. Each reads whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, rules
from .functions import urls as U
from .functions.shared import shared_folder
from .functions.text import BLANK
from .operators import consent, history, model, pages, risk, sampling
from .operators import urls as links
from .plans import pipelines
from .samples import WITH_TEXTS, cte, derived
from .sources.crawl import spread
from .streaming import jobs
from .streaming.ordered import use_rocksdb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table in WITH_TEXTS else df


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def sql_present(text: str, words) -> str:
    return f"len(list_filter({names(words)}, lambda w: contains(lower({text}), w)))"


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, {q(BLANK + '+')}, ' ', 'g'))"


def sql_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {q(pattern)}))"


ORIGIN = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
PATH = "CASE WHEN regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
QUERY = "regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def sql_params(u: str, params) -> str:
    kept = f"array_to_string(list_filter(string_split({QUERY.format(u=u)}, '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), {q(U.param_pattern(params))})), '&')"
    return f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"


def sql_canonical(u: str) -> str:
    path = f"({PATH.format(u=u)})"
    return f"({ORIGIN.format(u=u)} || CASE WHEN length({path}) > 1 THEN regexp_replace({path}, '/$', '') ELSE {path} END || {sql_params(u, rules.TRACKING_PARAMS)})"


# ---- addresses and links


@query("p1_canonical_urls", f"SELECT page_id, {sql_canonical('url')} AS canonical_url FROM pages")
def _(spark, d):
    return links.canonical_urls(read(spark, d, "pages")).select("page_id", "canonical_url")


@query("p2_page_key_urls", "SELECT page_id, rtrim(split_part(url, '#', 1), '/') AS page_key FROM pages")
def _(spark, d):
    return links.page_key_urls(read(spark, d, "pages")).select("page_id", "page_key")


@query("p3_cache_key_urls", f"SELECT page_id, {ORIGIN.format(u='url')} || ({PATH.format(u='url')}) || {sql_params('url', rules.CACHE_PARAMS)} AS cache_key FROM pages")
def _(spark, d):
    return links.cache_key_urls(read(spark, d, "pages")).select("page_id", "cache_key")


ANCHOR = q(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>")
LINKS_SQL = f"""SELECT page_id, url AS page_url, i - 1 AS pos, regexp_extract(url, '^(https?://[^/?#]*)', 1) || h AS href, {sql_collapse("regexp_replace(l, '<[^>]*>', ' ', 'g')")} AS label
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {ANCHOR}, 1)) AS h, unnest(regexp_extract_all(html, {ANCHOR}, 2)) AS l,
    unnest(range(1, len(regexp_extract_all(html, {ANCHOR}, 1)) + 1)) AS i FROM pages) WHERE h LIKE '/%'"""


@query("p4_extract_links", f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href, label FROM ({LINKS_SQL})")
def _(spark, d):
    return links.extract_links(read(spark, d, "pages")).select("page_id", "pos", "href", "label")


KEYWORD = q("(?i)" + "|".join(dict.fromkeys(rules.PAGE_KEYWORDS)))


def _sql_translit(text: str) -> str:
    out, seen = f"lower({text})", []
    for latin, cyrillic in rules.TRANSLITERATION:
        if not any(latin.startswith(s) for s in seen):
            out = f"replace({out}, {q(latin)}, {q(cyrillic)})"
        seen.append(latin)
    return out


HEADS = "array_to_string(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)[1:5], ' ')"


@query("p12_legal_page_signals", f"""SELECT page_id, regexp_matches(url, {KEYWORD}) AS url_keyword, regexp_matches(url, {q('(?i)' + '|'.join(rules.DEDICATED_KEYWORDS))}) AS dedicated,
  regexp_matches({_sql_translit('url')}, {KEYWORD}) AS translit_keyword,
  regexp_matches(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || {HEADS}, {KEYWORD}) AS title_keyword FROM {{}}""".replace("FROM {}", "FROM pages"))
def _(spark, d):
    return links.legal_page_signals(read(spark, d, "pages"))


@query("p14_title_h1_gate", f"""SELECT page_id FROM pages WHERE regexp_matches(regexp_extract(substr(html, 1, 4000), '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' ||
  regexp_extract(substr(html, 1, 4000), '(?is)<h1[^>]*>(.*?)</h1>', 1), '(?i)(onth|tion of|des )')""")
def _(spark, d):
    return links.title_h1_gate(read(spark, d, "pages"), ["onth", "tion of", "des "]).select("page_id")


@query("p20_veto_urls", cte("legal_links") + f""" SELECT CASE WHEN regexp_matches(href, {q('(?i)' + rules.BADGE_URL)}) THEN 'badge' ELSE 'asset' END AS rule, count(*) AS removed
  FROM legal_links WHERE regexp_matches(href, {q('(?i)' + rules.BADGE_URL)}) OR regexp_matches(href, {q('(?i)' + rules.ASSET_URL)}) GROUP BY 1""")
def _(spark, d):
    return links.veto_urls(derived(spark, d, "legal_links"))[1]


def _sql_terms(text: str) -> str:
    return "(" + " + ".join(f"CASE WHEN regexp_matches({text}, {q('(?i)' + p)}) THEN {w} ELSE 0 END" for p, w in rules.LINK_WEIGHTS) + ")"


SEGMENTS = f"list_filter(string_split({PATH.format(u='href')}, '/'), lambda s: s <> '')"
SCORED_SQL = f"""first_links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, {sql_canonical('href')} ORDER BY pos) AS n FROM legal_links
  WHERE regexp_matches(href || ' ' || label, {KEYWORD})) WHERE n = 1),
parts AS (SELECT *, {SEGMENTS} AS seg FROM first_links),
tails AS (SELECT *, list_filter(seg, lambda s: NOT regexp_matches(s, '^[0-9][\\w-]*$')) AS named FROM parts),
scored AS (SELECT page_id, page_url, pos, href, label, CAST(CASE WHEN {_sql_terms('lower(label)')} = 0 AND (
    regexp_matches({PATH.format(u='href')}, {q('(?i)' + rules.COMMERCE_PATH)}) OR (len(seg) >= 2 AND regexp_matches(seg[-1], '[0-9]{{3,}}') AND len(string_split(seg[-2], '-')) >= 4)) THEN -100
  ELSE {_sql_terms("lower(coalesce(named[-1], seg[-1], ''))")} + {_sql_terms('lower(label)')} END AS INTEGER) AS score FROM tails)"""


@query("w1_rank_legal_links", cte("legal_links") + f""", {SCORED_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM scored WHERE score >= 0)
  SELECT page_id, pos, href, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3""")
def _(spark, d):
    return links.rank_legal_links(derived(spark, d, "legal_links"), 3).select("page_id", "pos", "href", "score", "rank")


SITE_TEXT = f"lower({PATH.format(u='url')} || ' ' || CASE WHEN {QUERY.format(u='url')} <> '' THEN '?' || {QUERY.format(u='url')} ELSE '' END)"
RANKED_URLS = f"""decoded AS (SELECT *, replace({SITE_TEXT}, '%20', ' ') AS t FROM sitemap),
  points AS (SELECT site, pos, url, CAST(5 * {sql_present('t', rules.SLUG_PHRASES)} + 4 * len(list_filter(regexp_split_to_array(t, {q('[^a-z0-9À-ɏЀ-ӿ]+')}), lambda x: x IN ({", ".join(map(q, rules.SLUG_TOKENS))}))) AS INTEGER) AS score FROM decoded),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos) AS rank FROM points WHERE score > 0)"""


@query("w2_rank_legal_urls", cte("sitemap") + f", {RANKED_URLS} SELECT site, pos, url, score FROM ranked WHERE rank <= 5")
def _(spark, d):
    return links.rank_legal_urls(derived(spark, d, "sitemap"))


@query("w3_dedupe_first", cte("legal_links") + f" SELECT page_id, min(pos) AS pos FROM legal_links GROUP BY page_id, {sql_canonical('href')}")
def _(spark, d):
    return links.dedupe_first(derived(spark, d, "legal_links")).select("page_id", "pos")


def _lang(u: str) -> str:
    return f"lower(regexp_extract({PATH.format(u=u)}, '^/([A-Za-z]{{2}})(?:/|$)', 1))"


TRANSLATED_SQL = f"""idents AS (SELECT *, {_lang('href')} AS lang, {_lang('page_url')} AS page_lang, list_filter({SEGMENTS}, lambda s: regexp_matches(s, '[0-9]{{3,}}'))[-1] AS ident FROM scored_links),
  groups AS (SELECT *, coalesce(ident, '#' || CAST(pos AS VARCHAR)) AS g FROM idents),
  wanted AS (SELECT *, bool_or(lang = page_lang) OVER (PARTITION BY page_id, g) AS any_own, first_value(lang) OVER (PARTITION BY page_id, g ORDER BY pos) AS first_lang FROM groups)
  SELECT page_id, pos, href, score FROM wanted
  QUALIFY row_number() OVER (PARTITION BY page_id, g ORDER BY CASE WHEN any_own THEN lang = page_lang ELSE lang = first_lang END DESC, score DESC, length(href), pos) = 1"""


@query("w4_translated_duplicates", cte("legal_links") + f", scored_links AS (SELECT *, length(label) AS score FROM legal_links), {TRANSLATED_SQL}")
def _(spark, d):
    scored = derived(spark, d, "legal_links").withColumn("score", F.length("label").cast("long"))
    return links.resolve_translated_duplicates(scored).select("page_id", "pos", "href", "score")


@query("j4_exclude_disabled", f"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)
  SELECT page_id, host FROM h WHERE host NOT IN (SELECT host FROM h WHERE page_id % 17 = 0)""")
def _(spark, d):
    p = read(spark, d, "pages")
    return links.exclude_disabled_domains(p, p.where("page_id % 17 = 0").select(U.hostname(F.col("url")).alias("host"))).select("page_id", "host")


@query("j5_supplement_candidates", cte("sitemap", "legal_links") + f""", {RANKED_URLS}, known AS (SELECT DISTINCT {sql_canonical('href')} AS k FROM legal_links WHERE page_id % 2 = 0),
  counts AS (SELECT {ORIGIN.format(u='href')} AS o, count(*) AS n FROM legal_links WHERE page_id % 2 = 0 GROUP BY 1)
  SELECT {ORIGIN.format(u='url')} AS origin, url, score FROM points WHERE score >= 4 AND {sql_canonical('url')} NOT IN (SELECT k FROM known) AND {ORIGIN.format(u='url')} NOT IN (SELECT o FROM counts WHERE n >= 20)""")
def _(spark, d):
    scored = links.rank_legal_urls(derived(spark, d, "sitemap"), 1 << 30)
    return links.supplement_candidates(derived(spark, d, "legal_links").where("page_id % 2 = 0"), scored, 20)


@query("j11_self_link_filter", cte("legal_links") + f""" SELECT page_id, pos, href FROM legal_links WHERE {sql_canonical('href')} <> {sql_canonical('page_url')}
  AND NOT ({PATH.format(u='href')} = '/' AND {ORIGIN.format(u='href')} = {ORIGIN.format(u='page_url')} AND {PATH.format(u='page_url')} <> '/')""")
def _(spark, d):
    return links.self_link_filter(derived(spark, d, "legal_links")).select("page_id", "pos", "href")


@query("a11_url_variant_groups", f"SELECT {sql_canonical('url')} AS canonical_url, count(*) AS variants, arg_min(url, page_id) AS representative FROM pages GROUP BY 1")
def _(spark, d):
    return links.url_variant_groups(read(spark, d, "pages"))


@query("u4_union_candidates", cte("legal_links", "sitemap") + f""", top AS (SELECT max(pos) AS m FROM legal_links),
  both AS (SELECT page_id, page_url, pos, href, label, 0 AS score FROM legal_links UNION ALL
    SELECT CAST(floor(pos / 10) AS BIGINT), url, pos + m + 1, url, '', 1 FROM sitemap, top),
  scored_links AS (SELECT * FROM both QUALIFY row_number() OVER (PARTITION BY page_id, {sql_canonical('href')} ORDER BY pos) = 1), {TRANSLATED_SQL}""".replace("both AS", "every AS").replace("FROM both", "FROM every"))
def _(spark, d):
    own = derived(spark, d, "legal_links").withColumn("score", F.lit(0))
    more = derived(spark, d, "sitemap").select(F.floor(F.col("pos") / 10).alias("page_id"), F.col("url").alias("page_url"), "pos", F.col("url").alias("href"), F.lit("").alias("label"), F.lit(1).alias("score"))
    return links.union_candidates(own, more).select("page_id", F.col("pos").cast("long").alias("pos"), "href", F.col("score").cast("int").alias("score"))


@query("u5_new_vs_known", cte("sitemap", "legal_links") + f" SELECT url FROM sitemap WHERE {sql_canonical('url')} NOT IN (SELECT {sql_canonical('href')} FROM legal_links)")
def _(spark, d):
    key = lambda c: U.canonical(F.col(c), rules.TRACKING_PARAMS).alias("key")
    return links.new_vs_known(derived(spark, d, "sitemap").select("url", key("url")), derived(spark, d, "legal_links").select(key("href"))).select("url")


@query("s3_sitemap_urls", cte("sitemap") + f""", inner_maps AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY pos) AS r, url FROM sitemap)
  SELECT site, CAST(r AS INTEGER) AS pos, url FROM inner_maps""")
def _(spark, d):
    """Robots files and two levels of maps made from the sitemap table: per site an index of three maps, of which the first
    is missing, the second is in another language and the third holds the site's addresses."""
    rows = derived(spark, d, "sitemap")
    at = lambda path: F.concat(F.lit("https://"), "site", F.lit(path))
    loc = lambda url: F.concat(F.lit("<url><loc>"), url, F.lit("</loc></url>"))
    sites = rows.select("site").distinct()
    robots = sites.select("site", at("/en/start").alias("page_url"), F.concat(F.lit("User-agent: *\nSitemap: "), at("/index.xml"), F.lit("\n")).alias("text"))
    index = sites.select(at("/index.xml").alias("sitemap_url"), F.concat(*(loc(at(f"/{x}/sitemap.xml")) for x in ("ja", "de", "en"))).alias("xml"))
    other = sites.select(at("/de/sitemap.xml").alias("sitemap_url"), loc(at("/de/datenschutz")).alias("xml"))
    urls_in = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda r: loc(r["url"])), "")
    maps = rows.groupBy("site").agg(urls_in.alias("xml")).select(at("/en/sitemap.xml").alias("sitemap_url"), "xml").unionByName(other)
    return links.sitemap_urls(robots, index.unionByName(maps)).select("site", "pos", "url")


# ---- pages to documents


def sql_strip(html: str) -> str:
    """Main text by other means than the operator: element ends become marks, and the innermost marked spans go first."""
    out = f"regexp_replace({html}, {q('(?is)^.*?<body(?:[\\s/][^>]*)?>')}, '')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), {q('(?is)<script(?:[\\s/][^>]*)?>.*?</script[\\s/]*>|<style(?:[\\s/][^>]*)?>.*?</style[\\s/]*>')}, ' ', 'g')"
    kinds = ("nav", "header", "footer", "svg", "noscript")
    for i, tag in enumerate(kinds, 1):
        out = f"regexp_replace(regexp_replace({out}, {q(f'(?i)<{tag}(?:[\\s/](?:\"[^\"]*\"|[^>\"])*)?>')}, chr({i}), 'g'), {q(f'(?i)</{tag}[\\s/]*>')}, chr({16 + i}), 'g')"
    for _ in range(3):
        for i in range(1, len(kinds) + 1):
            out = f"regexp_replace({out}, '\\x{i:02x}[^\\x{i:02x}\\x{16 + i:02x}]*\\x{16 + i:02x}', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)[\\x01-\\x05].*$', ' '), '(?s)<[^>]*>|[\\x11-\\x15]', ' ', 'g')"
    for mark, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = f"replace({out}, {q(mark)}, {q(char)})"
    return sql_collapse(out)


@query("p5_main_text", f"SELECT page_id, url, {sql_strip('html')} AS text FROM pages")
def _(spark, d):
    return pages.main_text(read(spark, d, "pages"))


@query("s1_read_crawl", "SELECT page_id, url, length(html) AS n FROM pages")
def _(spark, d):
    from .sources.crawl import read_crawl

    return read_crawl(spark, f"{d}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("s2_decode_bodies", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'iso-8859-1' ELSE 'utf-8' END AS charset, html AS text FROM pages")
def _(spark, d):
    p = read(spark, d, "pages")
    odd = F.col("page_id") % 3 == 0
    fits = F.col("html").cast("binary")
    raw = p.select("page_id", F.when(odd, "text/html; charset=iso-8859-1").otherwise("text/html").alias("content_type"), F.when(odd, F.encode(F.col("html"), "iso-8859-1")).otherwise(fits).alias("body"))
    return pages.decode_bodies(raw)


OUTCOME = f"""CASE WHEN status >= 400 THEN 'http_error' WHEN NOT regexp_matches(content_type, '(?i)html') THEN 'content_type'
  WHEN regexp_matches(t, '(?i)quota limits|exceeding recaptcha') THEN 'quota_page' WHEN length(html) >= 2000 AND length(t) < 200 THEN 'js_rendered' WHEN length(t) < 200 THEN 'too_thin'
  WHEN {sql_count('t', rules.CODE_TOKENS)} >= 6 AND {sql_count('t', rules.CODE_TOKENS)} / greatest(length(t), 1) > 0.002 THEN 'source_code' ELSE 'ok' END"""


@query("s8_fetch_outcomes", cte("fetches") + f", s AS (SELECT *, {sql_strip('html')} AS t FROM fetches) SELECT page_id, {OUTCOME} AS outcome, status IN (403, 429, 503) AS retryable FROM s")
def _(spark, d):
    return pages.fetch_outcomes(derived(spark, d, "fetches"))


KINDS = ("http_error", "content_type", "quota_page", "js_rendered", "too_thin", "source_code", "ok")


@query("a6_outcome_histogram", cte("fetches") + f""", s AS (SELECT *, {sql_strip('html')} AS t FROM fetches), o AS (SELECT page_id, {OUTCOME} AS outcome FROM s)
  SELECT page_id % 50 AS origin_page, count(*) AS links, {", ".join(f"count(*) FILTER (outcome = '{k}') AS n_{k}" for k in KINDS)}, bool_and(outcome = 'js_rendered') AS js_suspect FROM o GROUP BY 1""")
def _(spark, d):
    f = derived(spark, d, "fetches")
    return pages.outcome_histogram(pages.fetch_outcomes(f), f.select((F.col("page_id") % 50).alias("origin_page"), "page_id"))


@query("p6_rendered_text_whole", f"""WITH t AS (SELECT page_id * 2 + n.i AS page_id, CASE WHEN n.i = 0 THEN {sql_strip('html')} END AS s, CASE WHEN page_id % 3 = 1 THEN repeat('payload ', 40) END AS p,
    CASE WHEN page_id % 2 = 0 THEN repeat('shown ', 60) END AS r FROM pages CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) n)
  SELECT page_id, CASE WHEN length(s) >= 200 THEN s WHEN length(p) >= 200 THEN p WHEN r IS NOT NULL THEN trim(r) ELSE s END AS text,
    CASE WHEN length(s) >= 200 THEN 'static' WHEN length(p) >= 200 THEN 'payload' WHEN r IS NOT NULL THEN 'rendered' ELSE 'static' END AS chosen FROM t""")
def _(spark, d):
    """Every page twice: with its whole main text, and without static text."""
    t = pages.main_text(read(spark, d, "pages"))
    both = t.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), "page_id", "text")
    own = both.select((F.col("page_id") * 2 + F.col("i")).alias("page_id"), F.when(F.col("i") == 0, F.col("text")).alias("static_text"), F.when(F.col("page_id") % 3 == 1, F.repeat(F.lit("payload "), 40)).alias("payload_text"))
    shown = both.where("page_id % 2 = 0").select((F.col("page_id") * 2 + F.col("i")).alias("page_id"), F.repeat(F.lit("shown "), 60).alias("rendered_text"))
    return pages.rendered_text_choice(own, shown)


QUERIES["p6_rendered_text_choice"], ORACLES["p6_rendered_text_choice"] = QUERIES["p6_rendered_text_whole"], ORACLES["p6_rendered_text_whole"]  # the older name


@query("p7_payload_prose", f"""SELECT page_id, t AS text FROM (SELECT page_id, {sql_collapse("replace(replace(" + sql_strip('html') + ", '\"', ' '), chr(92), ' ')")} AS t FROM pages) WHERE length(t) >= 200 AND contains(t, ' ')""")
def _(spark, d):
    """Pages whose text lies in a script only, as a literal."""
    t = pages.main_text(read(spark, d, "pages")).select("page_id", F.translate("text", '"\\', "  ").alias("t"))
    return pages.payload_prose(t.select("page_id", F.concat(F.lit('<html><script>push("'), "t", F.lit('")</script></html>')).alias("html")))


@query("p7_payload_islands", ORACLES["p7_payload_prose"])
def _(spark, d):
    """Pages whose text lies below keys and lists of a JSON island, in JSON that is a string itself."""
    t = pages.main_text(read(spark, d, "pages")).select("page_id", F.translate("text", '"\\', "  ").alias("t"))
    inner = F.concat(F.lit('{\\"children\\":[1,null,{\\"body\\":\\"'), "t", F.lit('\\"}]}'))
    island = F.concat(F.lit('<script id="x" type="application/json">{"a rather long key with blanks, which is no prose at all":{"props":["short",{"data":"'), inner, F.lit('"}]}}</script>'))
    return pages.payload_prose(t.select("page_id", F.concat(F.lit("<html>"), island, F.lit("</html>")).alias("html")))


@query("p8_strip_boilerplate", cte("policy_docs") + " SELECT doc_id, " + sql_collapse("replace(text, chr(9), ' ')") + " AS text FROM policy_docs")
def _(spark, d):
    dirty = derived(spark, d, "policy_docs").select("doc_id", F.concat(F.lit("Protected by reCAPTCHA Click for more info. "), "text", F.lit(" Trustpilot 4.8 excellent")).alias("text"))
    return pages.strip_boilerplate(dirty)


@query("p9_drop_source_like", cte("fetches") + f" SELECT page_id FROM (SELECT page_id, {sql_strip('html')} AS t FROM fetches) WHERE NOT ({sql_count('t', rules.CODE_TOKENS)} >= 6 AND {sql_count('t', rules.CODE_TOKENS)} / greatest(length(t), 1) > 0.002)")
def _(spark, d):
    return pages.drop_source_like(derived(spark, d, "fetches").select("page_id", pages.strip_tags(F.col("html")).alias("text"))).select("page_id")


SYMBOLS = r"[^\p{L}\p{M}\p{N}\s\x{00a0}\x{feff}\x{2028}\x{2029}\x{3000}.,;:!?'\x22()\[\]{}\-–—/\\]"
PROSE_SQL = f"""prose_a AS (SELECT *, substr(text, 1, 6000) AS s FROM documents),
prose_b AS (SELECT *, length(s) AS total, {sql_count('s', r'[\p{L}\p{M}]')} AS letters, {sql_count('s', r'\p{N}')} AS digits, {sql_count('s', SYMBOLS)} AS symbols,
  {sql_count('s', '[.!?…]')} - {sql_count('s', '[0-9][.!?…]')} + {sql_count('s', '[。！？।؟۔]')} AS ends,
  list_filter(regexp_split_to_array(s, {q(BLANK + '+')}), lambda t: regexp_matches(t, '\\p{{L}}')) AS words FROM prose_a),
prose_c AS (SELECT *, (letters + digits) / greatest(ends, 1) AS mean, CASE WHEN len(words) >= 40 THEN len(list_distinct(list_transform(words, lambda w: lower(w)))) / len(words) ELSE 1 END AS variety FROM prose_b),
prose AS (SELECT doc_id, text, CASE WHEN total < 50 THEN 0.0::DOUBLE ELSE round(greatest(0, least(1,
  CASE WHEN letters / total >= 0.55 THEN 0.45::DOUBLE WHEN letters / total >= 0.4 THEN 0.3 WHEN letters / total >= 0.25 THEN 0.1 ELSE 0 END
  + CASE WHEN symbols / total <= 0.02 THEN 0.25 WHEN symbols / total <= 0.05 THEN 0.15 WHEN symbols / total <= 0.1 THEN 0.05 ELSE 0 END
  + CASE WHEN ends >= 3 THEN 0.2 WHEN ends >= 1 THEN 0.1 ELSE -0.3 END
  + CASE WHEN ends < 1 THEN 0 WHEN mean >= 45 THEN 0.15 WHEN mean >= 20 THEN 0.08 ELSE 0 END
  - CASE WHEN digits / greatest(letters + digits, 1) > 0.08 THEN 0.2 ELSE 0 END - CASE WHEN variety < 0.35 THEN 0.15 ELSE 0 END + CASE WHEN letters > 400 THEN 0.05 ELSE 0 END)), 4) END AS prose_score FROM prose_c)"""


@query("p10_prose_quality", f"WITH {PROSE_SQL} SELECT doc_id, prose_score FROM prose")
def _(spark, d):
    return pages.prose_quality(read(spark, d, "documents")).select("doc_id", "prose_score")


@query("p11_prose_gate", f"""WITH {PROSE_SQL} SELECT doc_id, CASE WHEN prose_score >= 0.55 THEN 'prose' ELSE 'short_legal' END AS kind FROM prose
  WHERE length(text) >= 300 AND prose_score >= 0.4 AND NOT ({sql_count('text', rules.CODE_TOKENS)} >= 6 AND {sql_count('text', rules.CODE_TOKENS)} / greatest(length(text), 1) > 0.002)""")
def _(spark, d):
    return pages.prose_gate(read(spark, d, "documents")).select("doc_id", "kind")


@query("a10_vocabulary_variety", f"""SELECT doc_id, len(w) AS tokens, CASE WHEN len(w) >= 40 THEN round(len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w), 6) ELSE 1.0 END::DOUBLE AS variety
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, {q(BLANK + '+')}), lambda t: regexp_matches(t, '\\p{{L}}')) AS w FROM documents)""")
def _(spark, d):
    return pages.vocabulary_variety(read(spark, d, "documents"))


def _sql_language(table: str, key: str) -> str:
    """Counts the profiles anew from the sample texts, and scores texts by joins on n-grams."""
    plain = lambda t: f"' ' || trim(regexp_replace(lower({t}), {q('[^\\p{L}\\p{Nl}\\p{No}]+')}, ' ', 'g')) || ' '"
    ladder = " ".join(f"WHEN regexp_matches(text, {q(p)}){' AND regexp_matches(text, ' + q(rules.SCRIPTS[-1][1]) + ')' if x in ('uk', 'ru') else ''} THEN '{x}'" for x, p in rules.SCRIPTS)
    zipped = lambda source, id_: f"(SELECT {id_}, unnest(list_zip(l, l[2:], l[3:])) AS z FROM (SELECT {id_}, string_split(t, '') AS l FROM {source}))"
    cut = lambda source, id_: f"SELECT {id_}, n, gram, count(*) AS c FROM (SELECT {id_}, unnest([1, 2, 3]) AS n, unnest([z[1], z[1] || z[2], z[1] || z[2] || z[3]]) AS gram FROM {zipped(source, id_)}) WHERE gram IS NOT NULL GROUP BY ALL"
    given = ", ".join(f"({q(lang)}, {q(text)})" for lang, text in languages.SAMPLES.items())
    return f"""lang_texts AS (SELECT lang, {plain('text')} AS t FROM (VALUES {given}) v(lang, text)), lang_grams AS ({cut('lang_texts', 'lang')}),
  lang_seen AS (SELECT n, gram FROM lang_grams GROUP BY ALL), lang_known AS (SELECT n, count(*) AS k FROM lang_seen GROUP BY n),
  lang_total AS (SELECT lang, n, sum(c) + {languages.PSEUDO}::DOUBLE * (any_value(k) + 1) AS total FROM lang_grams JOIN lang_known USING (n) GROUP BY lang, n),
  lang_other AS (SELECT lang, n, round({languages.SCALE} * ln({languages.PSEUDO}::DOUBLE / total)) AS w FROM lang_total),
  lang_weights AS (SELECT s.n, s.gram, t.lang, round({languages.SCALE} * ln((coalesce(g.c, 0) + {languages.PSEUDO}::DOUBLE) / t.total)) - o.w AS w
    FROM lang_seen s JOIN lang_total t ON t.n = s.n JOIN lang_other o ON o.n = s.n AND o.lang = t.lang LEFT JOIN lang_grams g ON g.n = s.n AND g.gram = s.gram AND g.lang = t.lang),
  own_texts AS (SELECT {key}, {plain('text')} AS t FROM {table} WHERE NOT regexp_matches(text, {q('|'.join(p for _, p in rules.SCRIPTS))})), own_grams AS MATERIALIZED ({cut('own_texts', key)}),
  own_scores AS (SELECT {key}, lang, sum(s) AS s FROM (SELECT {key}, lang, sum(c * w) AS s FROM own_grams JOIN lang_weights USING (n, gram) GROUP BY ALL
    UNION ALL SELECT {key}, lang, sum(c * w) AS s FROM own_grams JOIN lang_other USING (n) GROUP BY ALL) GROUP BY ALL),
  guesses AS (SELECT {key}, arg_max(lang, (s, -CASE WHEN lang = 'en' THEN 0 ELSE ascii(lang) * 128 + ascii(lang[2:]) END)) AS lang FROM own_scores GROUP BY {key}),
  languages AS (SELECT d.{key}, CASE {ladder} WHEN trim({plain('text')}) = '' THEN 'en' ELSE coalesce(g.lang, 'en') END AS detected FROM {table} d LEFT JOIN guesses g USING ({key}))"""


@query("p21_detect_language", f"WITH {_sql_language('documents', 'doc_id')} SELECT doc_id, detected FROM languages")
def _(spark, d):
    return pages.detect_language(read(spark, d, "documents"))


@query("p22_usable_text", cte("payloads") + """ , g AS (SELECT *, CASE WHEN length(text) >= 30 AND text <> 'No readable text was found on this page.' THEN text END AS good FROM payloads),
  f AS (SELECT page, ts, good, last_value(good IGNORE NULLS) OVER (PARTITION BY page ORDER BY ts ROWS UNBOUNDED PRECEDING) AS t FROM g) SELECT page, ts, t AS text, good IS NULL AS from_cache FROM f WHERE t IS NOT NULL""")
def _(spark, d):
    return pages.usable_text_filter(derived(spark, d, "payloads"), ["No readable text was found on this page."])


@query("w5_dedupe_text", f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower({sql_collapse('text')})")
def _(spark, d):
    return pages.dedupe_text(read(spark, d, "documents")).select("doc_id")


@query("a7_best_candidate", cte("segments") + " SELECT page_id, arg_max(text, length(text) * 10 - pos) AS text, bool_or(pos = 1) AS legal_surface, bool_or(length(text) < 80) AS js_suspect, count(*) AS samples FROM segments GROUP BY 1")
def _(spark, d):
    return pages.best_candidate(derived(spark, d, "segments").select("page_id", F.col("pos").alias("sample"), "text", (F.col("pos") == 1).alias("legal_surface"), (F.length("text") < 80).alias("js_suspect")))


# ---- consent


@query("p15_dynamic_consent", cte("policy_docs") + f" SELECT doc_id, {sql_present('text', rules.CONSENT_WORDS)} >= 2 AS dynamic_consent FROM policy_docs")
def _(spark, d):
    return consent.dynamic_consent_flag(derived(spark, d, "policy_docs")).select("doc_id", "dynamic_consent")


@query("p16_consent_signals", cte("segments") + f" SELECT page_id, pos FROM segments WHERE {sql_count('text', rules.CONSENT_MARKERS)} >= 2")
def _(spark, d):
    return consent.consent_signal_filter(derived(spark, d, "segments")).select("page_id", "pos")


@query("p17_consent_segments", cte("consent_pages") + """ SELECT page_id, 'We and our partners store cookies on page ' || CAST(page_id AS VARCHAR) || '. You may manage cookies at any time.Accept all' ||
  CASE WHEN page_id % 2 = 0 THEN 'Reject all' ELSE '' END || 'Cookie settings' AS text, CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS controls FROM consent_pages WHERE contains(html, 'cookie-box')""")
def _(spark, d):
    found = consent.outermost_segments(consent.consent_segments(derived(spark, d, "consent_pages")))
    return found.select("page_id", "text", F.size("labels").alias("controls"))


@query("p18_consent_controls", cte("controls") + f""" SELECT page_id, {sql_collapse('label')} AS label, CASE WHEN regexp_matches(label, {q(rules.REJECT_LABEL)}) THEN 'reject' WHEN regexp_matches(label, {q(rules.MANAGE_LABEL)}) THEN 'manage' ELSE 'accept' END AS action
  FROM controls WHERE regexp_matches({sql_collapse('label')}, {q(rules.BUTTON_PHRASES)}) OR regexp_matches({sql_collapse('label')}, {q(rules.SHORT_BUTTONS)})""")
def _(spark, d):
    return consent.consent_controls(derived(spark, d, "controls").select("page_id", F.array("label").alias("labels")))


@query("p19_cmp_vendors", cte("resources") + f" SELECT v AS vendor, count(DISTINCT page_id) AS pages, count(DISTINCT page_host) AS sites FROM (SELECT *, unnest({names(rules.CONSENT_VENDORS)}) AS v FROM resources) WHERE contains(lower(resource_url), v) GROUP BY 1")
def _(spark, d):
    return consent.cmp_vendors(derived(spark, d, "resources"))


def _sql_prefixes(table: str) -> str:
    head = "len(list_filter(f.kept, lambda t: contains(t, substr(o.text, 1, 50)))) = 0"
    return cte(table).replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT page_id, pos, text, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM {table}),
  f AS (SELECT page_id, pos, rn, true AS keep, [text] AS kept FROM o WHERE rn = 1 UNION ALL
    SELECT o.page_id, o.pos, o.rn, {head}, CASE WHEN {head} THEN list_append(f.kept, o.text) ELSE f.kept END FROM f JOIN o ON o.page_id = f.page_id AND o.rn = f.rn + 1)
  SELECT page_id, pos FROM f WHERE keep"""


@query("w6_dedupe_prefix", _sql_prefixes("segments"))
def _(spark, d):
    return consent.dedupe_prefix(derived(spark, d, "segments")).select("page_id", "pos")


@query("w6_prefix_cascades", _sql_prefixes("cascades"))
def _(spark, d):
    """Each document, a segment that begins like it and holds the next one, and the next one."""
    return consent.dedupe_prefix(derived(spark, d, "cascades")).select("page_id", "pos")


@query("w7_outermost_segments", cte("segments") + """ SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY length(text), seg_start) AS INTEGER) AS rank FROM segments a
  WHERE NOT EXISTS (SELECT 1 FROM segments b WHERE b.page_id = a.page_id AND b.pos <> a.pos AND b.seg_start <= a.seg_start AND b.seg_end >= a.seg_end)""")
def _(spark, d):
    return consent.outermost_segments(derived(spark, d, "segments")).select("page_id", "pos", "rank")


@query("w8_longest_banner", cte("segments") + """, p AS (SELECT page_id, max(text) FILTER (pos = 0) AS a, max(text) FILTER (pos = 1) AS b, max(text) FILTER (pos = 2) AS c, max(text) FILTER (pos = 3) AS e FROM segments GROUP BY 1),
  x AS (SELECT *, CASE WHEN length(b) > length(a) THEN b ELSE a END AS t1, CASE WHEN length(b) > length(a) THEN 'iframe' ELSE 'popup' END AS k1 FROM p),
  y AS (SELECT *, CASE WHEN length(t1) < 600 AND length(c) > length(t1) THEN c ELSE t1 END AS t2, CASE WHEN length(t1) < 600 AND length(c) > length(t1) THEN 'vendor' ELSE k1 END AS k2 FROM x)
  SELECT page_id, CASE WHEN length(t2) < 150 AND length(e) > length(t2) THEN 'plain_iframe' ELSE k2 END AS kind, CASE WHEN length(t2) < 150 AND length(e) > length(t2) THEN e ELSE t2 END AS text FROM y""")
def _(spark, d):
    wide = derived(spark, d, "segments").groupBy("page_id").pivot("pos", [0, 1, 2, 3]).agg(F.max("text"))
    return consent.longest_banner(wide.select("page_id", F.col("0").alias("popup"), F.col("1").alias("iframe"), F.col("2").alias("vendor"), F.col("3").alias("plain_iframe"), F.lit(None).cast("string").alias("structural")))


@query("r6_cookie_choice", cte("controls", "policy_docs") + f""", c AS (SELECT page_id, {sql_collapse('label')} AS label FROM controls),
  k AS (SELECT page_id, label, CASE WHEN regexp_matches(label, {q(rules.REJECT_LABEL)}) THEN 'reject' WHEN regexp_matches(label, {q(rules.MANAGE_LABEL)}) THEN 'manage' ELSE 'accept' END AS action FROM c
    WHERE regexp_matches(label, {q(rules.BUTTON_PHRASES)}) OR regexp_matches(label, {q(rules.SHORT_BUTTONS)})),
  l AS (SELECT page_id, min(label) FILTER (action = 'accept') AS all_label, min(label) FILTER (action <> 'accept') AS essential_label FROM k GROUP BY 1),
  m AS (SELECT doc_id, list_sort(list_filter([{", ".join(f"CASE WHEN regexp_matches(text, {q('(?i)' + p)}) THEN {q(n)} END" for n, p in consent.DATA_KINDS.items())}], lambda x: x IS NOT NULL)) AS kinds FROM policy_docs)
  SELECT page_id, essential_label, all_label, array_to_string(kinds, ',') AS data_kinds, CASE WHEN len(kinds) >= 3 OR (list_contains(kinds, 'advertising') AND list_contains(kinds, 'third_parties')) THEN 'HIGH' WHEN len(kinds) >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS all_risk
  FROM l JOIN m ON doc_id = page_id""")
def _(spark, d):
    controls = consent.consent_controls(derived(spark, d, "controls").select("page_id", F.array("label").alias("labels")))
    return consent.cookie_choice_breakdown(controls, derived(spark, d, "policy_docs").withColumnRenamed("doc_id", "page_id"))


# ---- risk


def trackers_of(spark, d):
    table = rules.values_table(spark, [(x,) for x in rules.TRACKER_DOMAINS], "domain string")
    return risk.match_trackers(derived(spark, d, "resources"), table)


MATCH_SQL = f"""hosts AS (SELECT DISTINCT page_id, page_host, lower(regexp_extract(resource_url, '^https?://([^/?#:]*)', 1)) AS tracker_host FROM resources),
  matches AS (SELECT page_id, tracker_host FROM hosts WHERE tracker_host <> page_host AND len(list_filter({names(rules.TRACKER_DOMAINS)}, lambda t: tracker_host = t OR ends_with(tracker_host, '.' || t))) > 0)"""


@query("j1_match_trackers", cte("resources") + f", {MATCH_SQL} SELECT * FROM matches")
def _(spark, d):
    return trackers_of(spark, d)


@query("a5_tracker_summary", cte("resources") + f", {MATCH_SQL} SELECT page_id, count(*) AS n_trackers, string_agg(tracker_host, ',' ORDER BY tracker_host) AS trackers FROM matches GROUP BY 1")
def _(spark, d):
    return risk.tracker_summary(trackers_of(spark, d)).withColumn("trackers", F.array_join("trackers", ","))


MARKERS = rules.HIGH_MARKERS + rules.NETWORK_MARKERS


@query("j6_match_rules", cte("policy_docs") + f" SELECT doc_id, marker FROM (SELECT doc_id, text, unnest({names(MARKERS)}) AS marker FROM policy_docs) WHERE contains(lower(text), marker)")
def _(spark, d):
    return risk.match_rules(derived(spark, d, "policy_docs"), MARKERS)


@query("j6_match_rule_table", ORACLES["j6_match_rules"])
def _(spark, d):
    return risk.match_rule_table(derived(spark, d, "policy_docs"), rules.values_table(spark, [(m,) for m in MARKERS], "marker string"))


@query("a3_marker_presence", cte("policy_docs") + f" SELECT doc_id, CAST({sql_present('text', rules.HIGH_MARKERS)} AS INTEGER) AS high_hits, CAST({sql_present('text', rules.NETWORK_MARKERS)} AS INTEGER) AS network_hits FROM policy_docs")
def _(spark, d):
    return risk.marker_presence(derived(spark, d, "policy_docs"))


def _sql_findings() -> str:
    parts = []
    for i, (category, level, title, patterns, _why) in enumerate(rules.FINDING_RULES):
        match = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {q('(?i)' + p)}), '')" for p in patterns) + ")"
        parts.append(f"SELECT doc_id, {i} AS rule_id, {q(category)} AS category, {q(level)} AS attention_level, {q(title)} AS title, text, {match} AS m FROM policy_docs")
    evidence = "trim(substr(text, greatest(1, strpos(text, m) - 90), strpos(text, m) + length(m) + 180 - greatest(1, strpos(text, m) - 90)))"
    return f"found AS ({' UNION ALL '.join(parts)}), findings AS (SELECT doc_id, rule_id, category, attention_level, title, {evidence} AS evidence FROM found WHERE m IS NOT NULL)"


FINDINGS_SQL = _sql_findings()


def findings_of(spark, d):
    return risk.rule_findings(derived(spark, d, "policy_docs"))


@query("r1_rule_findings", cte("policy_docs") + f", {FINDINGS_SQL} SELECT doc_id, rule_id, category, attention_level, title, evidence FROM findings")
def _(spark, d):
    return findings_of(spark, d).drop("explanation")


@query("w16_first_pattern_evidence", f"""WITH m AS (SELECT doc_id, text, coalesce(nullif(regexp_extract(text, '(?i)apache license'), ''), nullif(regexp_extract(text, '(?i)licensed? under'), '')) AS m FROM documents)
  SELECT doc_id, trim(substr(text, greatest(1, strpos(text, m) - 90), strpos(text, m) + length(m) + 180 - greatest(1, strpos(text, m) - 90))) AS evidence FROM m WHERE m IS NOT NULL""")
def _(spark, d):
    return risk.first_pattern_evidence(read(spark, d, "documents"), [("TERMS", "LOW", "License", ["apache license", "licensed? under"], "")]).select("doc_id", "evidence")


@query("r2_rule_score", cte("policy_docs") + f""", {FINDINGS_SQL}, p AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN attention_level = 'HIGH' THEN 18 ELSE 9 END) AS p FROM findings GROUP BY 1)
  SELECT doc_id, CAST(greatest(20, 100 - coalesce(p, 0)) AS INTEGER) AS score, CASE WHEN n IS NULL THEN 'No supported risk signal was found in the text.' ELSE 'The rules found ' || n || ' supported signal(s) in the text.' END AS summary FROM policy_docs LEFT JOIN p USING (doc_id)""")
def _(spark, d):
    return risk.rule_score(derived(spark, d, "policy_docs"), findings_of(spark, d))


@query("a1_category_counts", cte("policy_docs") + f", {FINDINGS_SQL} SELECT doc_id, category, count(*) AS findings FROM findings GROUP BY 1, 2")
def _(spark, d):
    return risk.category_counts(findings_of(spark, d))


@query("a2_attention_counts", cte("policy_docs") + f", {FINDINGS_SQL} SELECT doc_id, count(*) FILTER (attention_level = 'HIGH') AS high, count(*) FILTER (attention_level = 'MEDIUM') AS medium, count(*) FILTER (attention_level = 'LOW') AS low FROM findings GROUP BY 1")
def _(spark, d):
    return risk.attention_counts(findings_of(spark, d))


PENALTY = "penalties AS (SELECT doc_id, CAST(sum(CASE attention_level WHEN 'HIGH' THEN 18 WHEN 'MEDIUM' THEN 9 WHEN 'LOW' THEN 3 ELSE 0 END) AS BIGINT) AS penalty, bool_or(attention_level = 'HIGH') AS has_high FROM findings GROUP BY 1)"


@query("a4_finding_penalty", cte("policy_docs") + f", {FINDINGS_SQL}, {PENALTY} SELECT * FROM penalties")
def _(spark, d):
    return risk.finding_penalty(findings_of(spark, d))


SCORES_SQL = f"""{FINDINGS_SQL}, {PENALTY}, {MATCH_SQL}, seen AS (SELECT page_id, count(*) AS n FROM matches GROUP BY 1),
  base AS (SELECT d.doc_id, d.domain, {sql_present('text', rules.HIGH_MARKERS)} AS h, {sql_present('text', rules.NETWORK_MARKERS)} AS w, coalesce(p.penalty, 0) AS p, coalesce(p.has_high, false) AS hh, coalesce(s.n, 0) AS t
    FROM policy_docs d LEFT JOIN penalties p USING (doc_id) LEFT JOIN seen s ON s.page_id = d.doc_id),
  raw AS (SELECT *, 100 - 18 * h - 5 * w - p - least(20, 4 * t) AS r FROM base),
  scores AS (SELECT doc_id, domain, CAST(h AS INTEGER) AS high_hits, CAST(w AS INTEGER) AS network_hits, CAST(t AS INTEGER) AS n_trackers,
    CAST(greatest(0, least(100, CASE WHEN h > 0 OR hh OR h + w + t >= 4 THEN least(r, 65) ELSE greatest(r, 85) END)) AS INTEGER) AS score FROM raw),
  labelled AS (SELECT *, CASE WHEN score >= 85 THEN 'Very safe' WHEN score >= 65 THEN 'Mostly safe' WHEN score >= 40 THEN 'Use with caution' WHEN score >= 20 THEN 'Risky' ELSE 'High risk' END AS label FROM scores)"""


def scores_of(spark, d):
    docs = derived(spark, d, "policy_docs")
    seen = risk.tracker_summary(trackers_of(spark, d)).select(F.col("page_id").alias("doc_id"), "n_trackers")
    return risk.document_scores(docs, seen, carry=("domain",))


@query("r3_safety_scores", cte("policy_docs", "resources") + f", {SCORES_SQL} SELECT doc_id, high_hits, network_hits, n_trackers, score, label FROM labelled")
def _(spark, d):
    return scores_of(spark, d).drop("domain")


@query("a9_site_risk_profile", cte("policy_docs", "resources") + f", {SCORES_SQL} SELECT domain, label, count(*) AS scans, min(score) AS min_score, round(avg(score), 4) AS mean_score FROM labelled GROUP BY ROLLUP (domain, label)")
def _(spark, d):
    return risk.site_risk_profile(scores_of(spark, d))


FACTS_SQL = f"""facts AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(do|does|will) not (sell or share|sell|share)') THEN false WHEN regexp_matches(text, '(?i)(share|disclose|sell)s? .{{0,60}}(third part|advertising partner|partners)') THEN true END AS declared_sharing,
  nullif(regexp_extract(text, {q(risk.CONTACT)}, 1), '') AS contact, regexp_matches(text, '(?i)opt[- ]out|right to object|to object') AS opt_out FROM policy_docs)"""


@query("r5_disclosure_facts", cte("policy_docs") + f", {FACTS_SQL} SELECT * FROM facts")
def _(spark, d):
    return risk.disclosure_facts(derived(spark, d, "policy_docs"))


def alerts_of(spark, d):
    seen = risk.tracker_summary(trackers_of(spark, d)).select(F.col("page_id").alias("doc_id"), "n_trackers")
    return risk.declared_vs_observed(risk.disclosure_facts(derived(spark, d, "policy_docs")), seen)


ALERT_SQL = f"{FACTS_SQL}, {MATCH_SQL}, seen AS (SELECT page_id, count(*) AS n FROM matches GROUP BY 1), alerts AS (SELECT doc_id, coalesce(declared_sharing = false AND n > 0, false) AS detected, CAST(coalesce(n, 0) AS INTEGER) AS n_trackers FROM facts LEFT JOIN seen ON page_id = doc_id)"


@query("j10_declared_vs_observed", cte("policy_docs", "resources") + f", {ALERT_SQL} SELECT * FROM alerts")
def _(spark, d):
    return alerts_of(spark, d)


FLAGS_SQL = f"""{ALERT_SQL}, {FINDINGS_SQL}, per AS (SELECT doc_id, count(*) FILTER (attention_level = 'HIGH') AS h, bool_or(attention_level = 'HIGH' OR category IN ('AI_USAGE', 'DATA_SALE')) AS c FROM findings GROUP BY 1),
  flags AS (SELECT doc_id, detected OR coalesce(h, 0) >= 1 AS needs_attention, detected OR coalesce(h, 0) >= 2 OR n_trackers >= 3 AS should_warn, coalesce(c, false) AS critical FROM alerts LEFT JOIN per USING (doc_id))"""


@query("r4_alert_flags", cte("policy_docs", "resources") + f", {FLAGS_SQL} SELECT * FROM flags")
def _(spark, d):
    return risk.alert_flags(findings_of(spark, d), alerts_of(spark, d))


@query("r7_opt_out_worklist", cte("policy_docs") + f""", {FACTS_SQL}, {FINDINGS_SQL} SELECT doc_id, coalesce(contact, 'the privacy team') AS recipient,
  'To ' || coalesce(contact, 'the privacy team') || ': I object to the processing of my data for purposes beyond the service (document ' || doc_id || ').' AS letter
  FROM facts WHERE opt_out OR doc_id IN (SELECT doc_id FROM findings WHERE category IN ('AI_USAGE', 'DATA_SALE'))""")
def _(spark, d):
    return risk.opt_out_worklist(risk.disclosure_facts(derived(spark, d, "policy_docs")), findings_of(spark, d))


@query("p13_legal_document_gate", cte("policy_docs") + f" SELECT doc_id FROM policy_docs WHERE regexp_matches(url, {q(rules.LEGAL_URL)}) OR {sql_present(chr(39).join(['url || ', ' ', ' || text']), rules.LEGAL_PHRASES)} >= 3 OR doc_id % 10 = 3")
def _(spark, d):
    docs = derived(spark, d, "policy_docs")
    return risk.legal_document_gate(docs, controls=docs.where("doc_id % 10 = 3").select("doc_id")).select("doc_id")


@query("j7_verify_evidence", cte("quotes") + " SELECT q.doc_id, q.rule_id, contains(d.text, q.evidence) AS verbatim, count(*) OVER (PARTITION BY q.doc_id, q.evidence) AS uses FROM quotes q JOIN documents d ON d.doc_id = q.doc_id")
def _(spark, d):
    return risk.verify_evidence(derived(spark, d, "quotes"), read(spark, d, "documents"))


@query("j7_verify_own_quotes", cte("own_quotes") + " SELECT q.doc_id, q.rule_id, contains(d.text, q.evidence) AS verbatim, count(*) OVER (PARTITION BY q.doc_id, q.evidence) AS uses FROM own_quotes q JOIN documents d ON d.doc_id = q.doc_id")
def _(spark, d):
    """The first sentence of every document, which is a true quote, and that of the next document."""
    return risk.verify_evidence(derived(spark, d, "own_quotes"), read(spark, d, "documents"))


@query("a8_pack_findings", cte("policy_docs") + f", {FINDINGS_SQL} SELECT doc_id, count(*) AS n, string_agg(title, '|' ORDER BY rule_id) AS titles FROM findings GROUP BY 1")
def _(spark, d):
    packed = risk.pack_findings(findings_of(spark, d))
    return packed.select("doc_id", F.size("findings").cast("long").alias("n"), F.array_join(F.transform("findings", lambda f: f["title"]), "|").alias("titles"))


# ---- versions and histories


@query("j2_reuse_analyses", cte("policy_docs") + f""", a AS (SELECT url, content_hash, md5(url) AS id FROM policy_docs WHERE doc_id % 3 <> 0 AND doc_id % 6 <> 1)
  SELECT d.doc_id, a.id AS analysis_id FROM policy_docs d JOIN a USING (url, content_hash) WHERE {sql_present('text', rules.CONSENT_WORDS)} < 2""")
def _(spark, d):
    docs = derived(spark, d, "policy_docs")
    stored = docs.where("doc_id % 3 <> 0").select("url", F.when(F.col("doc_id") % 6 != 1, F.col("content_hash")).alias("content_hash"), F.md5("url").alias("analysis_id"), F.lit(1).alias("created_at"))
    return history.reuse_analyses(docs, stored)[0]


@query("j3_previous_snapshot", cte("policy_docs", "versions") + """ SELECT doc_id, v.content_hash AS prev_hash, v.created_at AS prev_at FROM
  (SELECT doc_id, 'site' || CAST(doc_id AS VARCHAR) AS domain, ts - doc_id % 3 AS ts FROM policy_docs) d ASOF LEFT JOIN versions v ON d.domain = v.domain AND v.created_at < d.ts""")
def _(spark, d):
    docs = derived(spark, d, "policy_docs").select("doc_id", F.concat(F.lit("site"), F.col("doc_id").cast("string")).alias("domain"), (F.col("ts") - F.col("doc_id") % 3).alias("ts"))
    return history.previous_snapshot(docs, derived(spark, d, "versions"))


@query("u3_version_status", cte("policy_docs", "versions") + """, d AS (SELECT doc_id, 'site' || CAST(doc_id AS VARCHAR) AS domain, ts - doc_id % 4 AS ts, content_hash FROM policy_docs)
  SELECT doc_id, CASE WHEN v.content_hash IS NULL THEN 'new' WHEN v.content_hash = d.content_hash THEN 'unchanged' ELSE 'changed' END AS status, v.created_at AS prev_at FROM d ASOF LEFT JOIN versions v ON d.domain = v.domain AND v.created_at < d.ts""")
def _(spark, d):
    docs = derived(spark, d, "policy_docs").select("doc_id", F.concat(F.lit("site"), F.col("doc_id").cast("string")).alias("domain"), (F.col("ts") - F.col("doc_id") % 4).alias("ts"), "content_hash")
    return history.version_status(docs, derived(spark, d, "versions"))


@query("w9_latest_snapshot", cte("versions") + " SELECT domain, arg_max(content_hash, created_at) AS content_hash, max(created_at) AS created_at FROM versions GROUP BY 1")
def _(spark, d):
    return history.latest_snapshot(derived(spark, d, "versions"))


SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s)), lambda s: s <> '')"


def two_versions(spark, d):
    v = derived(spark, d, "versions").withColumnRenamed("domain", "key")
    return v.where("version_no = 0").select("key", "text"), v.where("version_no = 2").select("key", "text")


@query("u1_sentence_changes", cte("versions") + f""", s AS (SELECT domain AS key, unnest({SENTENCES}) AS sentence, CASE version_no WHEN 2 THEN 1 ELSE -1 END AS d FROM versions WHERE version_no <> 1)
  SELECT key, CASE WHEN sum(d) > 0 THEN 'added' ELSE 'removed' END AS type, sentence, CAST(abs(sum(d)) AS BIGINT) AS n FROM s GROUP BY key, sentence HAVING sum(d) <> 0""")
def _(spark, d):
    return history.sentence_changes(*two_versions(spark, d))


@query("u2_sentence_sequence_diff")
def _(spark, d):
    return history.sentence_sequence_diff(*two_versions(spark, d))


@query("u6_change_timeline", cte("versions") + f""", s AS (SELECT domain, created_at, unnest({SENTENCES}) AS sentence FROM versions), o AS (SELECT domain, created_at, lag(created_at) OVER (PARTITION BY domain ORDER BY created_at) AS prev_at FROM versions),
  x AS (SELECT o.domain, o.created_at, s.sentence, 1 AS d FROM o JOIN s ON s.domain = o.domain AND s.created_at = o.created_at UNION ALL SELECT o.domain, o.created_at, s.sentence, -1 FROM o JOIN s ON s.domain = o.domain AND s.created_at = o.prev_at),
  n AS (SELECT domain, created_at, sum(d) AS d FROM x GROUP BY domain, created_at, sentence)
  SELECT domain, created_at, prev_at, CAST(sum(greatest(d, 0)) AS BIGINT) AS added, CAST(sum(greatest(-d, 0)) AS BIGINT) AS removed FROM o JOIN n USING (domain, created_at) WHERE prev_at IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, d):
    return history.change_timeline(derived(spark, d, "versions"))


@query("s5_new_snapshots", cte("policy_docs", "versions") + """, l AS (SELECT domain, arg_max(content_hash, created_at) AS h FROM versions GROUP BY 1)
  SELECT doc_id FROM (SELECT doc_id, 'site' || CAST(doc_id AS VARCHAR) AS domain, content_hash FROM policy_docs) d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.domain = d.domain AND l.h = d.content_hash)""")
def _(spark, d):
    docs = derived(spark, d, "policy_docs").select("doc_id", F.concat(F.lit("site"), F.col("doc_id").cast("string")).alias("domain"), "content_hash")
    return history.new_snapshots(docs, derived(spark, d, "versions")).select("doc_id")


@query("s5_snapshot_table", cte("versions") + """, l AS (SELECT *, lag(content_hash) OVER (PARTITION BY domain ORDER BY created_at) AS before FROM versions)
  SELECT domain, content_hash, text AS raw_text, '{"domain":"' || domain || '","safety_score":' || length(text) % 101 || '}' AS analysis_json, created_at FROM l WHERE before IS DISTINCT FROM content_hash""")
def _(spark, d):
    """Three batches of versions, each appended twice to a bucketed table."""
    from .sources import crawl

    table, rows, path = f"snapshots_{uuid.uuid4().hex}", derived(spark, d, "versions"), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for no in (0, 0, 1, 1, 2, 2):
        batch = rows.where(F.col("version_no") == no)
        crawl.append_snapshot_table(batch, batch.select("domain", "content_hash", (F.length("text") % 101).alias("safety_score")), table, 8, path)
    schema = spark.table(table).schema
    spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(schema).parquet(path)  # the files stay


@query("plan_version_history", cte("policy_docs", "versions") + """, d AS (SELECT doc_id, 'site' || CAST(doc_id AS VARCHAR) AS domain, ts - doc_id % 4 AS ts, content_hash FROM policy_docs),
  latest AS (SELECT domain, arg_max(content_hash, created_at) AS h FROM versions GROUP BY 1)
  SELECT doc_id, CASE WHEN v.content_hash IS NULL THEN 'new' WHEN v.content_hash = d.content_hash THEN 'unchanged' ELSE 'changed' END AS status,
    NOT EXISTS (SELECT 1 FROM latest l WHERE l.domain = d.domain AND l.h = d.content_hash) AS appended FROM d ASOF LEFT JOIN versions v ON d.domain = v.domain AND v.created_at < d.ts""")
def _(spark, d):
    """Status of every document, and whether it is to be appended to the snapshots."""
    docs = derived(spark, d, "policy_docs").select("doc_id", F.concat(F.lit("site"), F.col("doc_id").cast("string")).alias("domain"), (F.col("ts") - F.col("doc_id") % 4).alias("ts"), "content_hash")
    status, fresh = pipelines.version_history(docs, derived(spark, d, "versions"))
    marked = fresh.select("doc_id", F.lit(True).alias("appended"))
    return status.join(marked, "doc_id", "left").select("doc_id", "status", F.coalesce("appended", F.lit(False)).alias("appended"))


@query("s6_read_analyses", cte("analyses") + """ SELECT analysis_id, coalesce(safety_score, 0) AS safety_score, coalesce(safety_prediction, CASE WHEN coalesce(safety_score, 0) >= 85 THEN 'Very safe' WHEN safety_score >= 65 THEN 'Mostly safe'
  WHEN safety_score >= 40 THEN 'Use with caution' WHEN safety_score >= 20 THEN 'Risky' ELSE 'High risk' END) AS safety_prediction FROM analyses""")
def _(spark, d):
    return history.derive_analyses(derived(spark, d, "analyses")).select("analysis_id", "safety_score", "safety_prediction")


@query("s4_append_analyses", ORACLES["s6_read_analyses"])
def _(spark, d):
    """Appended by day and read back."""
    from .sources import crawl

    path = f"{_shared(spark)}/analyses"
    rows = derived(spark, d, "analyses").withColumns({"created_at": F.timestamp_seconds(F.col("created_at") * 86400), "summary": F.lit(""), "title": F.lit("")})
    crawl.append_analyses(rows, path)
    return crawl.read_analyses(spark, path).select("analysis_id", "safety_score", "safety_prediction")


@query("s7_scan_stream", cte("scans") + " SELECT scan_id, client_id, url, content_hash, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM scans")
def _(spark, d):
    """A scan log as files, read as a stream and written batch by batch."""
    from .sources import crawl

    path = f"{_shared(spark)}/scans"
    derived(spark, d, "scans").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return _drain(crawl.scan_stream(spark, path)).select("scan_id", "client_id", "url", "content_hash", F.unix_micros("ts").alias("ts_us"))


@query("w10_recent_history", cte("analyses") + """ SELECT coalesce(client_id, 'legacy') AS client_id, analysis_id, CAST(row_number() OVER (PARTITION BY coalesce(client_id, 'legacy') ORDER BY created_at DESC, analysis_id DESC) AS INTEGER) AS rank
  FROM analyses QUALIFY rank <= 5""")
def _(spark, d):
    return history.recent_history(derived(spark, d, "analyses"), 5).select("client_id", "analysis_id", "rank")


SCAN_KEY = "regexp_replace(split_part(url, '#', 1), '/+$', '')"


@query("w11_mru_pages", cte("scans") + f", m AS (SELECT client_id, {SCAN_KEY} AS page_key, max(ts) AS last_ts FROM scans GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY last_ts DESC, page_key) AS INTEGER) AS rank FROM m QUALIFY rank <= 3")
def _(spark, d):
    return history.mru_pages(derived(spark, d, "scans"), 3)


@query("w12_recently_counted", cte("scans") + f" SELECT scan_id, coalesce(list_contains(list({SCAN_KEY}) OVER (PARTITION BY client_id ORDER BY ts, scan_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), {SCAN_KEY}), false) AS counted FROM scans")
def _(spark, d):
    return history.recently_counted(derived(spark, d, "scans")).select("scan_id", "counted")


def decisions(table: str, gap: str = "INTERVAL 12 HOURS") -> str:
    """The fold of W13 and T2 as recursion over each page's scans: hashes and times of its rows so far."""
    at = "list_position(f.times, list_max(f.times))"
    near = f"(o.ts - f.times[{at}] <= {gap} AND o.content_hash <> f.hashes[{at}])"
    known = "list_contains(f.hashes, o.content_hash)"
    put = lambda xs, x: f"f.{xs}[:{at} - 1] || [{x}] || f.{xs}[{at} + 1:]"
    return f"""ordered AS (SELECT client_id, url, content_hash, ts, row_number() OVER (PARTITION BY client_id, url ORDER BY ts, content_hash) AS rn FROM {table}),
  folded AS (SELECT *, [content_hash] AS hashes, [ts] AS times, 'insert' AS action FROM ordered WHERE rn = 1 UNION ALL
    SELECT o.*, CASE WHEN {near} THEN {put('hashes', 'o.content_hash')} WHEN {known} THEN f.hashes ELSE f.hashes || [o.content_hash] END,
      CASE WHEN {near} THEN {put('times', 'o.ts')} WHEN {known} THEN list_transform(f.times, lambda t: o.ts) ELSE f.times || [o.ts] END,
      CASE WHEN {near} THEN 'overwrite' WHEN {known} THEN 'bump' ELSE 'insert' END
    FROM folded f JOIN ordered o ON o.client_id = f.client_id AND o.url = f.url AND o.rn = f.rn + 1)"""


@query("w13_rescan_sessions", cte("scans") + """, n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM scans WINDOW w AS (PARTITION BY client_id, url ORDER BY ts, content_hash)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY client_id, url ORDER BY ts, content_hash ROWS UNBOUNDED PRECEDING) AS session FROM n)
  SELECT client_id, url, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS scans, arg_max(content_hash, (ts, content_hash)) AS content_hash FROM s GROUP BY client_id, url, session""")
def _(spark, d):
    return history.rescan_sessions(derived(spark, d, "scans"), "12 hours")


@query("w13_collapse_rescans", cte("scans").replace("WITH ", "WITH RECURSIVE ", 1) + f", {decisions('scans')} SELECT client_id, url, content_hash, ts, action FROM folded")
def _(spark, d):
    return history.collapse_rescans(derived(spark, d, "scans"), 12 * 3600)


@query("plan_scan_history", cte("scans").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {decisions('scans', 'INTERVAL 10 MINUTES')},
  a AS (SELECT client_id, count(*) FILTER (action = 'insert') AS inserts, count(*) FILTER (action = 'overwrite') AS overwrites, count(*) FILTER (action = 'bump') AS bumps FROM folded GROUP BY 1),
  m AS (SELECT client_id, {SCAN_KEY} AS page_key, max(ts) AS last_ts FROM scans GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY last_ts DESC, page_key) AS rank FROM m)
  SELECT client_id, CAST(rank AS INTEGER) AS rank, page_key, last_ts, inserts, overwrites, bumps FROM k JOIN a USING (client_id) WHERE rank <= 10""")
def _(spark, d):
    """The recent pages of each client beside the decisions on its scans."""
    decided, recent = pipelines.scan_history(derived(spark, d, "scans"))
    kinds = [F.count_if(F.col("action") == a).alias(f"{a}s") for a in ("insert", "overwrite", "bump")]
    return recent.join(decided.groupBy("client_id").agg(*kinds), "client_id").select("client_id", "rank", "page_key", "last_ts", "inserts", "overwrites", "bumps")


@query("w14_cap_history", cte("scans") + " SELECT scan_id, ts FROM scans ORDER BY ts DESC, scan_id DESC LIMIT 50")
def _(spark, d):
    return history.cap_newest(derived(spark, d, "scans"), 50, "ts", "scan_id").select("scan_id", "ts")


@query("w15_fresh_entries", cte("scans") + " SELECT scan_id FROM scans WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOURS")
def _(spark, d):
    return history.fresh_entries(derived(spark, d, "scans"), "24 hours", "2024-01-20 00:00:00").select("scan_id")


# ---- budgets and chunks

SHARES_SQL = """sized AS (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM blocks),
  wished AS (SELECT *, greatest(600, floor(6000 * n / total)) AS w FROM sized), summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id) AS s FROM wished),
  shares AS (SELECT doc_id, block_no, text, CAST(CASE WHEN total <= 6000 THEN n WHEN s > 6000 THEN greatest(200, floor(w * (6000.0::DOUBLE / s))) ELSE w END AS INTEGER) AS share FROM summed)"""


@query("c1_allocate_budget", cte("blocks") + f", {SHARES_SQL} SELECT doc_id, block_no, share FROM shares")
def _(spark, d):
    return sampling.allocate_budget(derived(spark, d, "blocks"), 6000).select("doc_id", "block_no", "share")


SAMPLE_SQL = f"""{SHARES_SQL}, cut AS (SELECT *, CAST(greatest(200, floor(share / 4)) AS BIGINT) AS f FROM shares), part AS (SELECT *, CAST(greatest(200, floor((share - f) / 3)) AS BIGINT) AS p, substr(text, f + 1) AS rest FROM cut),
  samples AS (SELECT doc_id, block_no, CASE WHEN length(text) <= share THEN text ELSE substr(text, 1, f) || chr(10) || '[...]' || chr(10) || substr(rest, 1, p) || chr(10) || '[...]' || chr(10) || substr(rest, CAST(floor(length(rest) * 1 / 3) AS BIGINT) + 1, p)
    || chr(10) || '[...]' || chr(10) || substr(rest, CAST(floor(length(rest) * 2 / 3) AS BIGINT) + 1, p) END AS sample FROM part)"""


@query("c2_sample_blocks", cte("blocks") + f", {SAMPLE_SQL} SELECT * FROM samples")
def _(spark, d):
    return sampling.sample_blocks(sampling.allocate_budget(derived(spark, d, "blocks"), 6000)).select("doc_id", "block_no", "sample")


@query("c5_reassemble", cte("blocks") + f", {SAMPLE_SQL} SELECT doc_id, string_agg(sample, chr(10) || chr(10) ORDER BY block_no) AS text FROM samples GROUP BY 1")
def _(spark, d):
    return pipelines.budgeted_context(derived(spark, d, "blocks"), 6000)


@query("c3_assemble_context", cte("segments") + """, p AS (SELECT page_id AS doc_id, max(text) FILTER (pos = 3) AS a, max(text) FILTER (pos = 1) AS b, max(text) FILTER (pos = 2) AS c FROM segments GROUP BY 1)
  SELECT doc_id, substr(concat_ws(chr(10) || chr(10), CASE WHEN length(a) >= 80 THEN substr(a, 1, 4000) END, nullif(substr(b, 1, 6000), ''), nullif(substr(c, 1, 18000), '')), 1, 30000) AS context FROM p""")
def _(spark, d):
    wide = derived(spark, d, "segments").groupBy("page_id").pivot("pos", [1, 2, 3]).agg(F.max("text"))
    return sampling.assemble_context(wide.select(F.col("page_id").alias("doc_id"), F.col("3").alias("banner"), F.col("1").alias("main"), F.col("2").alias("deep")))


@query("c4_chunk_sizes", f"""SELECT doc_id, CAST(CASE WHEN h = '' THEN 4500 ELSE greatest(200, least(4500, floor(2520 / ((3 * strlen(h) - 2 * {sql_count('h', "[A-Za-z0-9_.!~*'()-]")}) / length(h))))) END AS INTEGER) AS chunk_size
  FROM (SELECT doc_id, substr(text, 1, 2000) AS h FROM documents)""")
def _(spark, d):
    return sampling.chunk_sizes(read(spark, d, "documents"))


CHUNK_TYPE = "STRUCT(chunks VARCHAR[], open VARCHAR, joint VARCHAR, head BOOLEAN, long BOOLEAN, alone BOOLEAN, size INTEGER)"


def _sql_chunks() -> str:
    """The fold as list_reduce: pieces and state have one type."""
    made = lambda **f: "CAST({" + ", ".join(f"'{k}': {f.get(k, v)}" for k, v in {"chunks": "[]::VARCHAR[]", "open": "''", "joint": "''", "head": "false", "long": "false", "alone": "false", "size": "size"}.items()) + f"}} AS {CHUNK_TYPE})"
    edges = lambda t: f"regexp_replace({t}, {q(f'^{BLANK}+|{BLANK}+$')}, '', 'g')"
    sentence = f"CASE WHEN length(s) > size THEN list_transform(range(0, length(s), size), lambda i: {made(open='substr(s, i + 1, size)', joint=q(' '), head='j = 1', long='true', alone='true')}) ELSE [{made(open='s', joint=q(' '), head='j = 1', long='true')}] END"
    cut = f"list_filter(string_split(regexp_replace(b, {q(f'([.!?。！？\n]){BLANK}+')}, '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
    block = f"CASE WHEN length(b) > size THEN flatten(list_transform({cut}, lambda s, j: {sentence})) ELSE [{made(open='b', joint='chr(10) || chr(10)', head='true')}] END"
    closed = f"CASE WHEN a.open <> '' THEN list_append(a.chunks, {edges('a.open')}) ELSE a.chunks END"
    fits = "NOT (p.head AND (p.long OR a.long)) AND a.open <> '' AND length(a.open || p.joint || p.open) <= p.size"
    step = made(chunks=f"CASE WHEN p.alone THEN list_append({closed}, p.open) WHEN {fits} THEN a.chunks ELSE {closed} END", open=f"CASE WHEN p.alone THEN '' WHEN {fits} THEN a.open || p.joint || p.open ELSE p.open END", long="p.long", size="p.size")
    return f"""WITH sizes AS ({ORACLES['c4_chunk_sizes']}), t AS (SELECT doc_id, text, chunk_size AS size FROM documents JOIN sizes USING (doc_id)),
  p AS (SELECT doc_id, size, flatten(list_transform(list_filter(list_transform(string_split_regex(text, '\n{{2,}}'), lambda x: {edges('x')}), lambda x: x <> ''), lambda b: {block})) AS pieces FROM t),
  f AS (SELECT doc_id, list_reduce(pieces, lambda a, p: {step}, {made()}) AS a FROM p), c AS (SELECT doc_id, {closed} AS chunks FROM f)
  SELECT doc_id, CAST(unnest(range(0, least(48, len(chunks)))) AS INTEGER) AS chunk_no, unnest(chunks[1:48]) AS chunk, CAST(len(chunks) AS INTEGER) AS n_chunks FROM c"""


@query("c4_chunk_documents", _sql_chunks())
def _(spark, d):
    return sampling.chunk_documents(read(spark, d, "documents"))


# ---- model batches


@query("l1_conversation_messages", """SELECT conv_id, string_agg(CASE WHEN lower(role) IN ('user', 'system') THEN lower(role) ELSE 'assistant' END || ': ' || trim(text), chr(10) ORDER BY turn) AS messages FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY 1""")
def _(spark, d):
    return model.conversation_messages(read(spark, d, "conversations")).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


@query("l2_analysis_inputs", """SELECT doc_id, concat_ws(chr(10) || chr(10), 'LANGUAGE: ' || coalesce(lang, 'unknown'), 'TEXT:' || chr(10) || trim(text), CASE WHEN doc_id % 3 = 1 AND trim(replace(text, 'e', 'E')) <> trim(text) THEN 'TRANSLATION:' || chr(10) || trim(replace(text, 'e', 'E')) END) AS input FROM documents""")
def _(spark, d):
    docs = read(spark, d, "documents")
    return model.analysis_inputs(docs.withColumn("translated_text", F.when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("e"), F.lit("E"))).when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("")))


def stub(remainder: int, word: str):
    """A provider that answers every third id."""

    def answer(pdf):
        own = pdf[pdf["id"] % 3 == remainder]
        return own.assign(output=word + ":" + own["input"].str.len().astype(str))

    return answer


@query("l3_enrich", """SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'a:' || length(text) WHEN 1 THEN 'b:' || length(text) ELSE 'none' END AS output, CASE doc_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'rules' END AS source FROM documents""")
def _(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("input"))
    return model.enrich(docs, {"first": stub(0, "a"), "second": stub(1, "b")}, "none")


@query("l4_parse_responses", cte("raw_outputs") + " SELECT id, CASE id % 6 WHEN 0 THEN 'not_json' WHEN 1 THEN 'missing_field' WHEN 2 THEN 'score_range' ELSE 'bad_finding' END AS reason FROM raw_outputs WHERE id % 6 < 4")
def _(spark, d):
    return model.parse_responses(derived(spark, d, "raw_outputs"))[1]


@query("l4_parsed_results", cte("raw_outputs") + " SELECT id, CAST(json_extract(output, '$.safety_score') AS INTEGER) AS safety_score, json_extract_string(output, '$.findings[0].category') AS category FROM raw_outputs WHERE id % 6 >= 4")
def _(spark, d):
    return model.parse_responses(derived(spark, d, "raw_outputs"))[0].select("id", "safety_score", F.col("findings")[0]["category"].alias("category"))


@query("l5_provider_errors", cte("provider_log") + f""" SELECT provider, CASE WHEN {sql_present("coalesce(message, '')", rules.RATE_LIMIT_WORDS)} > 0 THEN 'rate_limit' WHEN {sql_present("coalesce(message, '')", rules.UNAVAILABLE_WORDS)} > 0 THEN 'model_unavailable' ELSE 'other' END AS kind, count(*) AS errors FROM provider_log GROUP BY 1, 2""")
def _(spark, d):
    return model.provider_errors(derived(spark, d, "provider_log"))


@query("l6_classify_documents", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN length(text) > 1000 ELSE true END AS legal, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'rules' END AS source FROM documents")
def _(spark, d):
    def judge(pdf):
        own = pdf[pdf["id"] % 3 == 0]
        return own.assign(output=(own["input"].str.len() > 1000).map({True: "true", False: "False"}))

    return model.classify_documents(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), {"first": judge})


def _sql_messages(table: str) -> str:
    case = lambda m: "CASE lang " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in m.items()) + f" ELSE {q(m['en'])} END"
    return f"SELECT id, CASE WHEN has_document THEN {case(rules.NO_PROVIDER)} ELSE {case(rules.NO_DOCUMENT)} END AS message FROM {table}"


@query("j8_localized_messages", f"WITH r AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, doc_id % 2 = 0 AS has_document FROM documents) {_sql_messages('r')}")
def _(spark, d):
    return model.localized_messages(read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), (F.col("doc_id") % 2 == 0).alias("has_document")))


@query("l7_fallback_answers", cte("questions") + f""", {_sql_language('questions', 'id')}, r AS (SELECT id, has_document, detected AS lang FROM questions JOIN languages USING (id)), m AS ({_sql_messages('r')}) SELECT id, message AS answer FROM m""")
def _(spark, d):
    return model.fallback_answers(derived(spark, d, "questions")).select("id", "answer")


@query("l8_answer_quotes", cte("quotes") + " SELECT q.doc_id * 1000 + q.rule_id AS id, CASE WHEN contains(d.text, q.evidence) THEN q.evidence END AS evidence_quote FROM quotes q JOIN documents d ON d.doc_id = q.doc_id")
def _(spark, d):
    answers = derived(spark, d, "quotes").select((F.col("doc_id") * 1000 + F.col("rule_id")).alias("id"), "doc_id", F.lit("yes").alias("answer"), F.col("evidence").alias("quote"))
    return model.answer_quotes(answers, read(spark, d, "documents")).select("id", "evidence_quote")


@query("l8_answer_own_quotes", cte("own_quotes") + " SELECT q.doc_id * 1000 + q.rule_id AS id, CASE WHEN contains(d.text, q.evidence) THEN q.evidence END AS evidence_quote FROM own_quotes q JOIN documents d ON d.doc_id = q.doc_id")
def _(spark, d):
    answers = derived(spark, d, "own_quotes").select((F.col("doc_id") * 1000 + F.col("rule_id")).alias("id"), "doc_id", F.lit("yes").alias("answer"), F.col("evidence").alias("quote"))
    return model.answer_quotes(answers, read(spark, d, "documents")).select("id", "evidence_quote")


@query("j9_reuse_translations", cte("blocks") + " SELECT b.doc_id, b.block_no AS chunk_no FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM blocks c WHERE c.text = b.text AND c.doc_id % 2 = 0)")
def _(spark, d):
    chunks = derived(spark, d, "blocks").select("doc_id", F.col("block_no").alias("chunk_no"), F.col("text").alias("chunk"), F.lit("en").alias("target"))
    cache = chunks.where("doc_id % 2 = 0").select("chunk", "target", F.upper("chunk").alias("translated"))
    return model.reuse_translations(chunks, cache)[1].select("doc_id", "chunk_no")


@query("a12_language_mix", cte("blocks") + """, b AS (SELECT doc_id, block_no, CASE WHEN length(text) % 3 = 0 THEN NULL ELSE 'l' || length(text) % 4 END AS detected, CASE WHEN length(text) % 5 = 0 THEN length(text) % 2 = 0 END AS translated FROM blocks)
  SELECT doc_id, arg_min(detected, block_no) AS detected, coalesce(bool_or(translated), false) AS any_translated FROM b GROUP BY 1""")
def _(spark, d):
    n = F.length("text")
    rows = derived(spark, d, "blocks").select("doc_id", F.col("block_no").alias("chunk_no"), F.when(n % 3 != 0, F.concat(F.lit("l"), (n % 4).cast("string"))).alias("detected"), F.when(n % 5 == 0, n % 2 == 0).alias("translated"))
    return model.language_mix(rows)


# ---- pipelines


def _sql_corpus() -> str:
    language = _sql_language("kept", "doc_id")
    prose = PROSE_SQL.replace("substr(text, 1, 6000) AS s", "text AS s").replace("FROM documents", "FROM fetched WHERE outcome = 'ok'").replace("doc_id, text,", "doc_id, url, text,", 1)
    prose = prose.replace("prose AS (SELECT doc_id, url, text,", "prose AS (SELECT doc_id, url, text,") if "prose AS (SELECT doc_id, url, text," in prose else prose.replace("prose AS (SELECT doc_id, text,", "prose AS (SELECT doc_id, url, text,")
    return cte("fetches") + f""", s AS (SELECT *, {sql_strip('html')} AS t FROM fetches), fetched AS (SELECT page_id AS doc_id, url, t AS text, {OUTCOME} AS outcome FROM s), {prose},
  gated AS (SELECT *, CASE WHEN prose_score >= 0.55 THEN 'prose' ELSE 'short_legal' END AS kind, {sql_canonical('url')} AS canonical_url FROM prose
    WHERE length(text) >= 300 AND prose_score >= 0.4 AND NOT ({sql_count('text', rules.CODE_TOKENS)} >= 6 AND {sql_count('text', rules.CODE_TOKENS)} / greatest(length(text), 1) > 0.002)),
  once AS (SELECT * FROM gated QUALIFY row_number() OVER (PARTITION BY lower({sql_collapse('text')}) ORDER BY doc_id) = 1),
  kept AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY doc_id) = 1), {language}
  SELECT doc_id, kind AS verdict, canonical_url, detected AS lang, sha256(text) AS content_hash FROM kept JOIN languages USING (doc_id)
  UNION ALL SELECT doc_id, CASE outcome WHEN 'ok' THEN 'not_prose_or_repeated' ELSE outcome END, NULL, NULL, NULL FROM fetched WHERE doc_id NOT IN (SELECT doc_id FROM kept)"""


@query("plan_clean_corpus", _sql_corpus())
def _(spark, d):
    """Every fetched page: a document with its kind, or the reason why it is none."""
    docs, lost = pipelines.clean_corpus(derived(spark, d, "fetches"))
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.col("kind").alias("verdict"), "canonical_url", "lang", "content_hash").unionByName(
        lost.select("doc_id", F.col("reason").alias("verdict"), none.alias("canonical_url"), none.alias("lang"), none.alias("content_hash"))
    )


@query("plan_risk_report", cte("policy_docs", "resources") + f""", {FLAGS_SQL}, {PENALTY}, {SCORES_SQL.split("FROM matches GROUP BY 1),", 1)[1]},
  n AS (SELECT doc_id, count(*) AS findings FROM findings GROUP BY 1)
  SELECT l.doc_id, l.score, l.label, coalesce(n.findings, 0) AS findings, f.needs_attention, f.should_warn, f.critical,
    a.opt_out OR l.doc_id IN (SELECT doc_id FROM findings WHERE category IN ('AI_USAGE', 'DATA_SALE')) AS letter
  FROM labelled l JOIN flags f USING (doc_id) JOIN facts a USING (doc_id) LEFT JOIN n USING (doc_id)""")
def _(spark, d):
    """Every document's findings, score, flags and whether a letter is written."""
    seen = risk.tracker_summary(trackers_of(spark, d)).select(F.col("page_id").alias("doc_id"), "n_trackers")
    findings, scored, flags, work = pipelines.risk_report(derived(spark, d, "policy_docs"), seen)
    per = findings.groupBy("doc_id").agg(F.count("*").alias("findings"))
    rows = scored.select("doc_id", "score", "label").join(flags, "doc_id").join(per, "doc_id", "left").join(work.select("doc_id", F.lit(True).alias("letter")), "doc_id", "left")
    return rows.select("doc_id", "score", "label", F.coalesce("findings", F.lit(0)).alias("findings"), "needs_attention", "should_warn", "critical", F.coalesce("letter", F.lit(False)).alias("letter"))


@query("plan_model_batch", """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 AND doc_id % 150 <= 100 THEN CAST(doc_id % 150 AS INTEGER) END AS safety_score,
  CASE WHEN doc_id % 2 = 1 THEN 'not_json' WHEN doc_id % 150 > 100 THEN 'score_range' END AS reason FROM documents""")
def _(spark, d):
    """A provider that answers every second document, some beyond the range of scores."""

    def answer(pdf):
        own = pdf[pdf["id"] % 2 == 0]
        return own.assign(output='{"domain":"a","safety_score":' + (own["id"] % 150).astype(str) + ',"summary":"s","findings":[]}')

    docs = read(spark, d, "documents").withColumn("translated_text", F.lit(""))
    done, rejected = pipelines.model_batch(docs, {"first": answer}, "no answer")
    return done.select("id", "safety_score", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("id", F.lit(None).cast("int").alias("safety_score"), "reason"))


# ---- flagship


@query("flagship_worst_sites", cte("policy_docs", "resources") + f""", {SCORES_SQL} SELECT domain, count(*) AS documents, min(score) AS min_score, round(avg(score), 4) AS mean_score FROM labelled GROUP BY 1 ORDER BY mean_score, domain LIMIT 10""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a crawl, scored by rules, markers and trackers; the ten worst sites."""
    per = scores_of(spark, d).groupBy("domain").agg(F.count("*").alias("documents"), F.min("score").alias("min_score"), F.round(F.avg("score"), 4).alias("mean_score"))
    return per.orderBy("mean_score", "domain").limit(10)


# ---- streams: each reads the events table as a stream of files and is read to its end


def _shared(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _drain(stream: DataFrame) -> DataFrame:
    """Run to the end of the input in append mode; the rows written."""
    from .sources.crawl import history_sink

    path = _shared(stream.sparkSession)
    history_sink(stream, f"{path}/out", f"{path}/state").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out/batch=*")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    use_rocksdb(spark)
    schema = read(spark, d, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern, so that a single file may be streamed
    return raw.select(
        F.col("event_id").alias("scan_id"), F.col("user_id").cast("string").alias("client_id"), F.concat(F.lit("https://app.example.com/"), "event_type").alias("url"),
        F.md5(F.floor(F.col("value") / 10).cast("long").cast("string")).alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type",
    )


STREAM_SQL = "s AS (SELECT event_id AS scan_id, CAST(user_id AS VARCHAR) AS client_id, 'https://app.example.com/' || event_type AS url, md5(CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)) AS content_hash, ts, value, event_type FROM events)"
#: Where the watermark stands at the end: ``late`` behind the newest row, in milliseconds. Later rows stay open.
CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) FROM s)"
LATE = "0 seconds"
IN_ORDER = "(PARTITION BY client_id ORDER BY ts, content_hash)"


@query("t1_stream_sessions", f"""WITH {STREAM_SQL}, n AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY client_id, url ORDER BY ts)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY client_id, url ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT client_id, url, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS scans FROM g GROUP BY client_id, url, session
  HAVING max(ts) + INTERVAL 12 HOURS <= {CLOSED} - INTERVAL 1 HOUR""")
def _(spark, d):
    out = _drain(jobs.stream_collapse_rescans(event_stream(spark, d), "12 hours"))
    return out.select("client_id", "url", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "scans")


@query("t2_stream_history", f"WITH RECURSIVE {STREAM_SQL}, {decisions('s')} SELECT client_id, url, content_hash, ts, action FROM folded WHERE ts <= {CLOSED}")
def _(spark, d):
    out = _drain(jobs.stream_history(event_stream(spark, d), 12 * 3600, LATE))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t3_stream_version_changes", f"""WITH {STREAM_SQL}, p AS (SELECT client_id, ts, lag(content_hash) OVER w AS prev_hash, content_hash FROM s WINDOW w AS {IN_ORDER})
  SELECT client_id AS domain, prev_hash, content_hash, CAST(epoch_us(ts) AS BIGINT) AS us FROM p WHERE prev_hash IS NOT NULL AND prev_hash <> content_hash AND ts <= {CLOSED}""")
def _(spark, d):
    docs = event_stream(spark, d).select(F.col("client_id").alias("domain"), "content_hash", "ts")
    return _drain(jobs.stream_version_changes(docs, LATE)).select("domain", "prev_hash", "content_hash", F.unix_micros("ts").alias("us"))


@query("t4_stream_dedupe", f"WITH {STREAM_SQL} SELECT DISTINCT client_id || url AS canonical_url FROM s")
def _(spark, d):
    rows = event_stream(spark, d).select(F.concat("client_id", "url").alias("canonical_url"), "ts")
    return _drain(jobs.stream_dedupe(rows, "60 days")).select("canonical_url")


FETCH_KINDS = "CASE event_type WHEN 'click' THEN 'static' WHEN 'view' THEN 'rendered' ELSE 'page' END"


@query("t4_stream_fetches", f"""WITH RECURSIVE {STREAM_SQL}, o AS (SELECT *, CAST(epoch_us(ts) AS BIGINT) AS us, row_number() OVER (PARTITION BY kind ORDER BY ts) AS rn FROM (SELECT ts, {FETCH_KINDS} AS kind FROM s)),
  f AS (SELECT kind, rn, us, us AS fetched FROM o WHERE rn = 1 UNION ALL
    SELECT o.kind, o.rn, o.us, CASE WHEN o.us - f.fetched >= CASE o.kind WHEN 'static' THEN 60000000 WHEN 'rendered' THEN 300000000 ELSE 86400000000 END THEN o.us ELSE f.fetched END
    FROM f JOIN o ON o.kind = f.kind AND o.rn = f.rn + 1)
  SELECT 'site' AS canonical_url, kind, us FROM f WHERE us = fetched AND us <= (SELECT CAST(epoch_us({CLOSED}) AS BIGINT)) GROUP BY kind, us""")
def _(spark, d):
    rows = event_stream(spark, d).select(F.lit("site").alias("canonical_url"), F.expr(FETCH_KINDS).alias("kind"), "ts")
    return _drain(jobs.stream_fetches(rows, late=LATE)).select("canonical_url", "kind", F.unix_micros("ts").alias("us"))


@query("t5_stream_longest_text", f"""WITH {STREAM_SQL}, l AS (SELECT client_id, ts, repeat('x', CAST(greatest(0, floor(value)) AS INTEGER)) AS text FROM s), m AS (SELECT *, max(length(text)) OVER (PARTITION BY client_id ORDER BY ts, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
  SELECT client_id AS page, CAST(length(text) AS INTEGER) AS n FROM m WHERE length(text) > coalesce(before, 0) AND ts <= {CLOSED}""")
def _(spark, d):
    frames = event_stream(spark, d).select(F.col("client_id").alias("page"), "ts", F.expr("repeat('x', cast(greatest(0, floor(value)) as int))").alias("text"))
    return _drain(jobs.stream_longest_text(frames, LATE, 60 * jobs.DAY_MS)).select("page", F.length("text").alias("n"))


@query("t6_stream_signature_changes", f"""WITH {STREAM_SQL}, g AS (SELECT client_id, ts, sha256(concat_ws(chr(1), url, content_hash, event_type, url)) AS signature FROM s), p AS (SELECT *, lag(signature) OVER (PARTITION BY client_id ORDER BY ts, signature) AS prev FROM g)
  SELECT client_id AS page, CAST(epoch_us(ts) AS BIGINT) AS us, signature FROM p WHERE prev IS DISTINCT FROM signature AND ts <= {CLOSED}""")
def _(spark, d):
    rows = event_stream(spark, d).select(F.col("client_id").alias("page"), "ts", "url", F.col("content_hash").alias("text"), F.array("event_type").alias("trackers"), F.array("url").alias("labels"))
    return _drain(jobs.stream_signature_changes(rows, LATE, 60 * jobs.DAY_MS)).select("page", F.unix_micros("ts").alias("us"), "signature")


@query("t7_stream_converged", f"""WITH {STREAM_SQL}, l AS (SELECT client_id || '|' || event_type AS page, ts, 300 + 10 * CAST(((CAST(floor(value) AS BIGINT) % 3) + 3) % 3 AS INTEGER) AS n FROM s),
  m AS (SELECT *, max(n) OVER w AS longest, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY page ORDER BY ts, n ROWS UNBOUNDED PRECEDING)),
  r AS (SELECT *, k - first_value(k) OVER (PARTITION BY page, longest ORDER BY k) AS same FROM m)
  SELECT page, arg_min(longest, k) AS length, CAST(epoch_us(min(ts)) AS BIGINT) AS us FROM r WHERE (longest >= 3000 OR longest >= 300 AND same >= 2) AND ts <= {CLOSED} GROUP BY page""")
def _(spark, d):
    rows = event_stream(spark, d).select(F.concat_ws("|", "client_id", "event_type").alias("page"), "ts", F.expr("repeat('x', 300 + 10 * cast(pmod(floor(value), 3) as int))").alias("text"))
    return _drain(jobs.stream_converged(rows, late=LATE, ttl_ms=60 * jobs.DAY_MS)).select("page", "length", F.unix_micros("ts").alias("us"))


@query("t8_stream_alert_rate", f"WITH {STREAM_SQL} SELECT event_type AS site, CAST(epoch_us(date_trunc('hour', ts)) AS BIGINT) AS start_us, count(*) AS scans, count(*) FILTER (value > 50) AS alerts FROM s GROUP BY 1, 2, date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} - INTERVAL 10 MINUTE")
def _(spark, d):
    rows = event_stream(spark, d).select(F.col("event_type").alias("site"), "ts", (F.col("value") > 50).alias("needs_attention"))
    return _drain(jobs.stream_alert_rate(rows)).select("site", F.unix_micros("start").alias("start_us"), "scans", "alerts")
