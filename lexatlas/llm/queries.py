"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.crawl import spread
from .common import bound_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import select_quality

    return select_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_shared_path
    from .warc import archive_pages

    return archive_pages(_table(spark, sf_dir, "pages"), new_shared_path(spark)).drop("archive", "byte_offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import repair_roles

    return repair_roles(_table(spark, sf_dir, "conversations"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text

    return extract_text(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_join import jaccard_links

    return jaccard_links(_table(spark, sf_dir, "documents")).drop("text_hash")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_links import link_embeddings

    return link_embeddings(_table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit_filters

    return audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter", "documents")


def op12_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 24)


def op13_cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings")).drop("cluster_size")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_warc_salvage": op3_warc_salvage,
    "op4_token_counts": op4_token_counts,
    "op5_chat_format": op5_chat_format,
    "op6_decontaminate": op6_decontaminate,
    "op7_html_extract": op7_html_extract,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_toxicity": op9_toxicity,
    "op10_mix_sources": op10_mix_sources,
    "op11_filter_audit": op11_filter_audit,
    "op12_shard_documents": op12_shard_documents,
    "op13_cluster_vectors": op13_cluster_vectors,
}

MIX_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all({text}, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM {docs}
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
    CAST(sum(source_size) OVER (ORDER BY source NULLS LAST) AS BIGINT) - source_size AS before, source_size * 2 AS most FROM per
), weighed AS (
  SELECT *, ([5, 2, 1])[CAST((rank - 1) % 3 + 1 AS INTEGER)] AS weight FROM ranked
), levels AS (
  SELECT 0 AS n, 1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::DOUBLE / (SELECT sum(weight) FROM weighed)::DOUBLE AS level
  UNION ALL
  SELECT n + 1, (1.5::DOUBLE * (SELECT sum(source_size) FROM weighed)::DOUBLE
    - (SELECT coalesce(sum(most), 0) FROM weighed WHERE most <= weight * level)::DOUBLE)
    / (SELECT sum(weight) FROM weighed WHERE most > weight * level)::DOUBLE
  FROM levels WHERE n < 40 AND (SELECT count(*) FROM weighed WHERE most > weight * level) > 0
), level AS (
  SELECT max(level) AS level FROM levels
), targets AS (
  SELECT weighed.*, CASE WHEN most <= weight * level THEN most::DOUBLE ELSE weight * level END AS target FROM weighed, level
), queued AS (
  SELECT b.doc_id, b.source, b.size, t.source_size, t.rank, t.target, md5(coalesce(b.doc_id::VARCHAR, '') || ':mix') AS key,
    CAST(sum(b.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(b.doc_id::VARCHAR, '') || ':mix'), b.doc_id, b.size
      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source
), entries AS (
  SELECT queued.*, p.pass, fin + p.pass * source_size AS upto FROM queued, (VALUES (0), (1)) p(pass) WHERE target > 0 AND size > 0
), sorted AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY upto / target, rank, pass, upto ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS at FROM entries
), words AS (
  SELECT doc_id, rank, fin, target, unnest(range(upto - size + 1, upto + 1)) AS k FROM entries
), mixed AS (
  SELECT doc_id, rank, fin, row_number() OVER (ORDER BY k / target, rank) AS place FROM words
), taken AS (
  SELECT doc_id, rank, fin, count(*) AS taken FROM mixed WHERE place <= (SELECT CAST(floor(1.5::DOUBLE * sum(size)) AS BIGINT) FROM base) GROUP BY ALL
)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken,
  CASE WHEN q.target > 0 THEN q.fin / q.target END AS finish, CASE WHEN t.taken > 0 THEN s.at END AS position
FROM queued q LEFT JOIN taken t ON q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.rank = t.rank AND q.fin = t.fin AND q.size > 0
LEFT JOIN sorted s ON s.pass = 0 AND q.doc_id IS NOT DISTINCT FROM s.doc_id AND q.rank = s.rank AND q.fin = s.fin AND q.size > 0
"""

JACCARD_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS words FROM documents
), classes AS (
  SELECT words, min(doc_id) AS copy_id, count(*) AS n_copies FROM texts WHERE len(words) > 0 GROUP BY words
), sets AS (
  SELECT copy_id, n_copies, list_distinct(list_transform(range(1, greatest(len(words) - 4, 1) + 1),
    lambda i: array_to_string(words[i : i + 4], ' '))) AS grams FROM classes
), grams AS (
  SELECT copy_id, unnest(grams) AS gram FROM sets
), common AS (
  SELECT a.copy_id AS u, b.copy_id AS v, count(*) AS n_both FROM grams a JOIN grams b ON a.gram = b.gram AND a.copy_id <> b.copy_id GROUP BY 1, 2
), links AS (
  SELECT u, v, y.n_copies AS other FROM common JOIN sets x ON x.copy_id = u JOIN sets y ON y.copy_id = v
  WHERE 10 * n_both >= 8 * (len(x.grams) + len(y.grams) - n_both)
), reach AS (
  SELECT copy_id AS node, copy_id AS seen FROM sets UNION SELECT node, v FROM reach JOIN links ON seen = u
), parts AS (
  SELECT node, min(seen) AS class_id FROM reach GROUP BY node
), degree AS (
  SELECT u, sum(other) AS links FROM links GROUP BY u
)
SELECT t.doc_id, coalesce(c.copy_id, t.doc_id) AS copy_id, coalesce(c.n_copies, 1) AS n_copies,
  CAST(coalesce(d.links, 0) + coalesce(c.n_copies, 1) - 1 AS BIGINT) AS n_links,
  coalesce(p.class_id, t.doc_id) AS class_id, t.doc_id = coalesce(p.class_id, t.doc_id) AS kept
FROM texts t LEFT JOIN classes c ON t.words = c.words LEFT JOIN degree d ON d.u = c.copy_id LEFT JOIN parts p ON p.node = c.copy_id
"""

LINKS_SQL = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT node, v FROM reach JOIN links ON seen = u
), parts AS (
  SELECT node, min(seen) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e JOIN parts p ON p.node = e.vec_id LEFT JOIN degree d ON d.u = e.vec_id
"""

WARC_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic, {
    'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)} AS fails
  FROM texts t LEFT JOIN marks m USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), bits AS (
  SELECT part, good, toxic, concat(CASE WHEN fails.A THEN 'A' ELSE '' END, CASE WHEN fails.B THEN 'B' ELSE '' END, CASE WHEN fails.C THEN 'C' ELSE '' END,
    CASE WHEN fails.D THEN 'D' ELSE '' END, CASE WHEN fails.E THEN 'E' ELSE '' END) AS failed FROM flags
), counted AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM bits GROUP BY part, failed
), steps AS (
  SELECT c.*, o.filter_order, s.step, o.filter_order[s.step] AS letter, contains(failed, o.filter_order[s.step]) AS own,
    failed <> '' AND len(list_filter(range(1, s.step), lambda i: contains(failed, o.filter_order[i]))) > 0 AS earlier
  FROM counted c, orders o, (SELECT unnest(range(1, 6)) AS step) s
), totals AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (NOT own AND NOT earlier) AS kept, sum(n) FILTER (own AND NOT earlier) AS removed,
    sum(n) FILTER (own AND earlier) AS redundant, sum(n) FILTER (own AND length(failed) = 1) AS unique_fails,
    sum(good) FILTER (own AND NOT earlier) AS good_lost, sum(toxic) FILTER (own AND NOT earlier) AS toxic_lost FROM steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley FROM totals
"""


def _cluster_sql(clusters: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """K-means round by round: a0, a1, ... assign the vectors to the centroids c0, c1, ..."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {clusters})",
    ]
    for i in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.r, arg_min(c.c, {far} * {clusters} + c.c) AS c, min({far}) AS distance FROM kept k, c{i} c GROUP BY k.r)")
        if i < rounds:
            mean = f"""SELECT a.c, list(m ORDER BY d) AS v FROM (SELECT a.c, d, CAST((sum(k.v[d]) - ((sum(k.v[d]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM a{i} a JOIN kept k USING (r), (SELECT unnest(range(1, {dims + 1})) AS d) GROUP BY a.c, d) a GROUP BY a.c"""
            parts.append(f"m{i} AS ({mean}), c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return "WITH " + ", ".join(parts) + f"""
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN kept k USING (r) JOIN c{rounds} c ON c.c = a.c"""


ORACLES = {
    "op11_filter_audit": AUDIT_SQL,
    "op13_cluster_vectors": _cluster_sql(),
    "op3_warc_salvage": WARC_SQL,
    "op1_ngram_join": JACCARD_SQL,
    "op2_embedding_dedup": LINKS_SQL,
    "op10_mix_sources": MIX_SQL.format(text="text", docs="documents"),
}
