"""URL keys, links and discovery of legal pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.text import collapse, decode_entities


def canonical_urls(df: DataFrame, param_rules: list[tuple[str, str]] = rules.TRACKING_PARAMS) -> DataFrame:
    """P1. Adds canonical_url: no fragment, no trailing slash, no tracking parameters."""
    return df.withColumn("canonical_url", urls.canonical(F.col("url"), param_rules))


def page_key_urls(df: DataFrame) -> DataFrame:
    """P2. Adds page_key, the looser key of histories: no fragment, no trailing slashes."""
    return df.withColumn("page_key", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", ""))


def cache_key_urls(df: DataFrame, param_rules: list[tuple[str, str]] = rules.CACHE_PARAMS) -> DataFrame:
    """P3. Adds cache_key, the key of fetches: no fragment and no tracking parameters; keeps a trailing slash."""
    key = F.concat(urls.origin(F.col("url")), urls.path(F.col("url")), urls.without_params(F.col("url"), param_rules))
    return df.withColumn("cache_key", F.when(urls.origin(F.col("url")) == "", F.regexp_replace("url", "#.*$", "")).otherwise(key))


def extract_links(pages: DataFrame) -> DataFrame:
    """P4. (page_id, page_url, pos, href, label): one row per anchor, its href, quoted or not, decoded and made absolute;
    javascript: and bare # dropped."""
    anchor = r"(?is)<a(?=\s)[^>]*?[\s\"'/]href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)[^>]*>(.*?)</a>"
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(found).alias("pos", "a"))
    raw = F.trim(decode_entities(F.regexp_replace("a.href", "^[\"']|[\"']$", "")))
    here = urls.origin(F.col("page_url"))
    absolute = (
        F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(F.regexp_extract("page_url", "^([A-Za-z]+:)", 1), raw))
        .when(raw.startswith("/"), F.concat(here, raw))
        .when(raw.startswith("#") | raw.startswith("?"), F.concat(F.regexp_replace("page_url", "[?#].*$", ""), raw))
        .otherwise(F.concat(here, F.regexp_replace(urls.path(F.col("page_url")), "[^/]*$", ""), raw))
    )
    kept = (raw != "") & ~F.lower(raw).startswith("javascript:") & ~raw.startswith("#")
    return rows.where(kept).select("page_id", "page_url", "pos", absolute.alias("href"), collapse(decode_entities(F.regexp_replace("a.label", "<[^>]*>", " "))).alias("label"))


def tail_segment(url: Column) -> Column:
    """Last path segment that is not a number with word characters, else the last one."""
    parts = F.reverse(urls.segments(url))
    named = F.filter(parts, lambda s: ~s.rlike(r"^\d[\w-]*$"))
    return F.lower(F.coalesce(F.get(named, F.lit(0)), F.get(parts, F.lit(0)), F.lit("")))


def term_score(text: Column, weights: list[tuple[str, int]] = rules.LINK_WEIGHTS) -> Column:
    return sum((F.when(text.rlike("(?i)" + p), w).otherwise(0) for p, w in weights), F.lit(0))


def commerce(url: Column) -> Column:
    """A catalogue segment, a product parameter, or a long slug followed by a number."""
    parts = urls.segments(url)
    names = F.transform(F.split(urls.query(url), "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1)))
    slug = (F.size(parts) >= 2) & F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit("")).rlike(r"\d{3,}") & (F.size(F.split(F.coalesce(F.get(F.reverse(parts), F.lit(1)), F.lit("")), "-")) >= 4)
    return urls.path(url).rlike("(?i)" + rules.COMMERCE_PATH) | F.exists(names, lambda n: n.rlike("(?i)" + rules.COMMERCE_PARAM)) | slug


def score_links(links: DataFrame) -> DataFrame:
    """Adds score, as rank_legal_links uses it."""
    href, label = F.col("href"), F.lower(F.coalesce(F.col("label"), F.lit("")))
    own = term_score(label)
    foreign = href.rlike("(?i)" + rules.VENDOR_URL) & ~F.contains(href, urls.hostname(F.col("page_url")))
    total = term_score(tail_segment(href)) + own - F.when(href.rlike("(?i)" + rules.BADGE_URL), 100).otherwise(0) - F.when(foreign, 100).otherwise(0)
    return links.withColumn("score", F.when((own == 0) & commerce(href), -100).otherwise(total).cast("int"))


def rank_legal_links(links: DataFrame, k: int = 12, keywords: list[str] = rules.PAGE_KEYWORDS) -> DataFrame:
    """W1. The k best links of each page to its own origin that name a legal keyword, scored from the address's tail
    and the label; equal scores keep page order, variants of one canonical address count once."""
    word = "(?i)" + "|".join(dict.fromkeys(keywords))
    same = urls.origin(F.col("href")) == urls.origin(F.col("page_url"))
    named = F.concat_ws(" ", "href", "label").rlike(word) & ~F.col("href").rlike("(?i)iasme|certificate|blockmarktech|trusted-shops|quota limits|exceeding recaptcha")
    scored = score_links(dedupe_first(links.where(same & named))).where("score >= 0")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def dedupe_first(links: DataFrame) -> DataFrame:
    """W3. The first link of each page and canonical address."""
    first = F.row_number().over(W.partitionBy("page_id", urls.canonical(F.col("href"), rules.TRACKING_PARAMS)).orderBy("pos"))
    return links.withColumn("_n", first).where("_n = 1").drop("_n")


def self_link_filter(links: DataFrame) -> DataFrame:
    """J11. Drops links to the page itself, and to the home page unless the page is the home page."""
    key = lambda c: urls.canonical(F.col(c), rules.TRACKING_PARAMS)
    home = (urls.path(F.col("href")) == "/") & (urls.origin(F.col("href")) == urls.origin(F.col("page_url")))
    return links.where((key("href") != key("page_url")) & ~(home & (urls.path(F.col("page_url")) != "/")))


def veto_urls(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P20. Links without those to badges, checks and assets; and the number removed per rule."""
    rule = F.when(F.col("href").rlike("(?i)" + rules.BADGE_URL), "badge").when(F.col("href").rlike("(?i)" + rules.ASSET_URL), "asset")
    marked = links.withColumn("rule", rule)
    return marked.where("rule is null").drop("rule"), marked.where("rule is not null").groupBy("rule").agg(F.count("*").alias("removed"))


def resolve_translated_duplicates(links: DataFrame) -> DataFrame:
    """W4. One link per page and document identity (origin and last path segment with an id of three digits or more):
    links in the page's language if any, else in that of the first; then score, shorter address, position."""
    last = F.coalesce(F.get(F.filter(F.reverse(urls.segments(F.col("href"))), lambda s: s.rlike(r"\d{3,}")), F.lit(0)), F.lit(""))
    lang = lambda c: F.regexp_extract(urls.path(F.col(c)), "^/([A-Za-z]{2})(?:/|$)", 1)
    ident = F.when(last == "", F.concat(F.lit("#"), F.col("pos").cast("string"))).otherwise(F.concat(urls.origin(F.col("href")), F.lit("|"), last))
    df = links.withColumn("ident", ident).withColumn("lang", F.lower(lang("href"))).withColumn("own", F.col("lang") == F.lower(lang("page_url")))
    group = W.partitionBy("page_id", "ident")
    wanted = F.when(F.max("own").over(group), F.col("own")).otherwise(F.col("lang") == F.min_by("lang", "pos").over(group))
    best = F.row_number().over(group.orderBy(F.desc("wanted"), F.desc("score"), F.length("href"), "pos"))
    return df.withColumn("wanted", wanted).withColumn("_n", best).where("_n = 1").select(*links.columns)


def rank_legal_urls(sitemap: DataFrame, k: int = 5, tokens: list[str] = rules.SLUG_TOKENS, phrases: list[str] = rules.SLUG_PHRASES) -> DataFrame:
    """W2. (site, pos, url, score): the first k sitemap addresses of each site, in sitemap order, that score above 0:
    5 for each phrase in the decoded path and 4 for each token that is in the list."""
    whole = F.lower(F.concat_ws(" ", urls.path(F.col("url")), F.when(urls.query(F.col("url")) != "", F.concat(F.lit("?"), urls.query(F.col("url")))).otherwise("")))
    text = F.coalesce(F.try_url_decode(F.regexp_replace(whole, r"\+", "%2B")), whole)
    found = F.filter(F.split(text, r"[^a-z0-9\x{00c0}-\x{024f}\x{0400}-\x{04ff}]+"), lambda t: t.isin(*dict.fromkeys(tokens)))
    score = sum((F.when(text.contains(p), 5).otherwise(0) for p in phrases), F.lit(0)) + 4 * F.size(found)
    rank = F.row_number().over(W.partitionBy("site").orderBy("pos"))
    return sitemap.withColumn("score", score.cast("int")).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def sitemap_urls(robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """S3. (site, pos, url) from robots (site, text, and page_url if known) and sitemaps (sitemap_url, xml): the first two
    Sitemap lines, and one nested level of at most six maps (.xml addresses that name a sitemap), no assets. A first path
    segment of ``page_url`` of at most five characters is a language: its maps come first, and of the others only the
    first one listed is read. Without page_url, or where it has no such segment, all maps are alike."""
    lines = F.slice(F.regexp_extract_all("text", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1)), 1, 2)
    page = F.col("page_url") if "page_url" in robots.columns else F.lit(None).cast("string")
    segment = F.regexp_extract(page, r"^\w+://[^/?#]*/+([^/?#]{1,5})(?:[/?#]|$)", 1)
    prefix = F.when(segment != "", F.concat(F.lit("/"), segment, F.lit("/")))
    top = robots.select("site", prefix.alias("prefix"), F.posexplode(lines).alias("m", "sitemap_url"))
    locs = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    maps = sitemaps.select("sitemap_url", F.posexplode(locs).alias("n", "loc"))
    is_map = F.col("loc").rlike(r"(?i)\.xml(\?|$)") & F.col("loc").rlike("(?i)sitemap")
    level1 = top.join(maps, "sitemap_url").select("site", "prefix", "m", "n", "loc", is_map.alias("is_map"))
    site = W.partitionBy("site")
    nested = level1.where("is_map").withColumn("own", F.coalesce(F.contains("loc", "prefix"), F.lit(False)))
    nested = nested.withColumn("at", F.row_number().over(site.orderBy("m", "n"))).where("prefix IS NULL OR own OR at = 1")
    few = nested.withColumn("r", F.row_number().over(site.orderBy(F.desc("own"), "at"))).where("r <= 6")
    inner = maps.select(F.col("sitemap_url").alias("loc"), F.col("n").alias("b"), F.col("loc").alias("url"))
    level2 = few.join(inner, "loc").select("site", F.lit(1).alias("level"), F.col("r").alias("a"), "b", "url")
    level1 = level1.where("NOT is_map").select("site", F.lit(0).alias("level"), F.col("m").alias("a"), F.col("n").alias("b"), F.col("loc").alias("url"))
    every = level1.unionByName(level2).where(~F.col("url").rlike("(?i)" + rules.ASSET_URL))
    return every.withColumn("pos", F.row_number().over(site.orderBy("level", "a", "b"))).select("site", "pos", "url")


def supplement_candidates(links: DataFrame, sitemap: DataFrame, least: int = 3, score: int = 4) -> DataFrame:
    """J5. (origin, url, score) of sitemap addresses of origins with fewer than ``least`` links, with at least
    ``score``, that no link has in canonical form."""
    key = lambda c: urls.canonical(F.col(c), rules.TRACKING_PARAMS)
    counts = links.groupBy(urls.origin(F.col("href")).alias("origin")).agg(F.count("*").alias("links"))
    wanted = sitemap.withColumn("origin", urls.origin(F.col("url"))).where(F.col("score") >= score).withColumn("key", key("url"))
    few = wanted.join(counts, "origin", "left").where(F.coalesce("links", F.lit(0)) < least)
    return new_vs_known(few, links.select(key("href").alias("key"))).select("origin", "url", "score")


def new_vs_known(candidates: DataFrame, known: DataFrame, key: str = "key") -> DataFrame:
    """U5. Candidates whose key is not known."""
    return candidates.join(known.select(key).distinct(), key, "left_anti")


def union_candidates(page_links: DataFrame, sitemap_links: DataFrame) -> DataFrame:
    """U4. Page links, then sitemap links behind them, one per page and document."""
    shift = page_links.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("m"))
    behind = sitemap_links.crossJoin(F.broadcast(shift)).withColumn("pos", (F.col("pos") + F.col("m") + 1).cast("int")).drop("m")
    return resolve_translated_duplicates(dedupe_first(page_links.unionByName(behind)))


def url_variant_groups(pages: DataFrame) -> DataFrame:
    """A11. (canonical_url, variants, representative): addresses per canonical one, and the first of them."""
    df = canonical_urls(pages)
    return df.groupBy("canonical_url").agg(F.count("*").alias("variants"), F.min_by("url", "page_id").alias("representative"))


def legal_page_signals(pages: DataFrame) -> DataFrame:
    """P12. (page_id, url_keyword, dedicated, translit_keyword, title_keyword)."""
    word = "(?i)" + "|".join(dict.fromkeys(rules.PAGE_KEYWORDS))
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    heads = F.array_join(F.slice(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), 1, 5), " ")
    return pages.select(
        "page_id", F.col("url").rlike(word).alias("url_keyword"), F.col("url").rlike("(?i)" + "|".join(rules.DEDICATED_KEYWORDS)).alias("dedicated"),
        transliterate(F.col("url")).rlike(word).alias("translit_keyword"), F.concat_ws(" ", title, heads).rlike(word).alias("title_keyword"),
    )


def transliterate(text: Column, pairs: list[tuple[str, str]] = rules.TRANSLITERATION) -> Column:
    """Latin to Cyrillic, left to right: at each place the first pair in the list that fits. Replacing whole pairs in
    list order gives the same unless a shorter pair comes before a longer one that contains it; such later pairs never
    fit, and are left out."""
    out, seen = F.lower(text), []
    for latin, cyrillic in pairs:
        if not any(latin.startswith(s) for s in seen):
            out = F.replace(out, F.lit(latin), F.lit(cyrillic))
        seen.append(latin)
    return out


def title_h1_gate(pages: DataFrame, keywords: list[str] = rules.PAGE_KEYWORDS) -> DataFrame:
    """P14. Pages with a keyword in title or h1 within the first 4000 characters."""
    head = F.left("html", F.lit(4000))
    named = F.concat_ws(" ", F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1), F.regexp_extract(head, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    return pages.where(named.rlike("(?i)" + "|".join(dict.fromkeys(keywords))))


def exclude_disabled_domains(pages: DataFrame, disabled: DataFrame) -> DataFrame:
    """J4. Pages whose host name is not switched off."""
    return pages.withColumn("host", urls.hostname(F.col("url"))).join(disabled.select("host").distinct(), "host", "left_anti")
