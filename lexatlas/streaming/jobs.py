"""Jobs on streams of scans, pages and payloads. Every keyed state has a time to live in event time, counted from the
key's last row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import Fold, Histories, InEventOrder, Longest, in_event_order

DAY_MS = 24 * 3600 * 1000


def stream_collapse_rescans(scans: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """T1. Sessions of scans of a page by a client: (client_id, url, first_ts, last_ts, scans)."""
    rows = scans.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "client_id", "url")
    return rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("scans")).drop("session_window")


def _folded(stream: DataFrame, keys: list[str], value: str, fold: Fold, out: str, state: str, late: str, ttl_ms: int, kind=InEventOrder) -> DataFrame:
    return in_event_order(stream, keys, value, kind([f.split()[0] for f in out.split(", ")], state, fold, ttl_ms), out, late)


def stream_history(scans: DataFrame, gap_seconds: int = 600, late: str = "1 hour", ttl_ms: int = 30 * DAY_MS) -> DataFrame:
    """T2. (client_id, url, content_hash, ts, action) of each scan: overwrite, bump or insert, by the page's rows so far,
    one per distinct hash. A null hash is an empty one."""
    out = "client_id string, url string, content_hash string, ts timestamp, action string"
    processor = Histories([f.split()[0] for f in out.split(", ")], gap_seconds, ttl_ms)
    return in_event_order(scans, ["client_id", "url"], "content_hash", processor, out, late)


def stream_version_changes(docs: DataFrame, late: str = "1 hour", ttl_ms: int = 365 * DAY_MS) -> DataFrame:
    """T3. (domain, prev_hash, content_hash, ts) when a domain's hash differs from the last one before it; null hashes are passed over."""

    def fold(key, state, us, h):
        prev = state[0] if state else None
        if h is None:
            return [], (prev,)
        return [(key[0], prev, h, us)] if prev not in (None, h) else [], (h,)

    return _folded(docs, ["domain"], "content_hash", fold, "domain string, prev_hash string, content_hash string, ts timestamp", "hash string", late, ttl_ms)


def stream_dedupe(pages: DataFrame, ttl: str = "24 hours", key: str = "canonical_url") -> DataFrame:
    """T4. One fetch per canonical address within the time to live."""
    return pages.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key])


#: How long a fetch of each kind serves for the same address, in milliseconds.
FETCH_TTL_MS = {"static": 60_000, "rendered": 300_000, "page": DAY_MS}


def stream_fetches(pages: DataFrame, ttl_ms: Mapping[str, int] = FETCH_TTL_MS, late: str = "1 hour") -> DataFrame:
    """T4 by kind of fetch. (canonical_url, kind, ts) of the requests (canonical_url, kind, ts) that must be fetched: the
    first of an address and kind, and each that comes the kind's time to live or more after the last one fetched. A kind
    that is not listed is always fetched."""

    def fold(key, state, us, _):
        fresh = state and us - state[0] < ttl_ms.get(key[1], 0) * 1000
        return ([], state) if fresh else ([(*key, us)], (us,))

    out = "canonical_url string, kind string, ts timestamp"
    return _folded(pages, ["canonical_url", "kind"], "kind", fold, out, "fetched long", late, max(ttl_ms.values()))


def stream_longest_text(frames: DataFrame, late: str = "1 hour", ttl_ms: int = DAY_MS) -> DataFrame:
    """T5. (page, ts, text) whenever a page's longest consent text grows; null is an empty text."""

    def fold(key, state, us, text):
        most = state[0] if state else 0
        return ([(key[0], us, text)], (len(text),)) if len(text or "") > most else ([], (most,))

    return _folded(frames, ["page"], "text", fold, "page string, ts timestamp, text string", "most long", late, ttl_ms, Longest)


def stream_signature_changes(payloads: DataFrame, late: str = "1 hour", ttl_ms: int = DAY_MS) -> DataFrame:
    """T6. (page, ts, signature) of payloads (page, ts, url, text, trackers, labels) whose signature is not the last one;
    the first one counts as a change."""
    signature = F.sha2(F.concat_ws("\u0001", "url", "text", F.array_join(F.array_sort("trackers"), ","), F.array_join("labels", ",")), 256)

    def fold(key, state, us, s):
        return [(key[0], us, s)] if state is None or state[0] != s else [], (s,)

    return _folded(payloads.select("page", "ts", signature.alias("signature")), ["page"], "signature", fold, "page string, ts timestamp, signature string", "signature string", late, ttl_ms)


def stream_converged(samples: DataFrame, enough: int = 3000, least: int = 300, repeats: int = 2, late: str = "1 hour", ttl_ms: int = DAY_MS) -> DataFrame:
    """T7. (page, ts, length) once a page's longest text so far has ``enough`` characters, or has not grown for ``repeats`` samples
    at ``least`` characters. Only lengths wait."""

    def fold(key, state, us, length):
        longest, same, done = state or (0, 0, False)
        n = int(length)
        longest, same = (n, 0) if n > longest else (longest, same + 1)
        now = not done and (longest >= enough or (longest >= least and same >= repeats))
        return [(key[0], us, longest)] if now else [], (longest, same, done or now)

    lengths = samples.select("page", "ts", F.format_string("%010d", F.length(F.coalesce("text", F.lit("")))).alias("length"))
    return _folded(lengths, ["page"], "length", fold, "page string, ts timestamp, length int", "longest long, same long, done boolean", late, ttl_ms)


def stream_alert_rate(analyses: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """T8. (site, start, scans, alerts) per tumbling window; rows later than ``late`` are dropped."""
    per = analyses.withWatermark("ts", late).groupBy(F.window("ts", window), "site")
    return per.agg(F.count("*").alias("scans"), F.count_if("needs_attention").alias("alerts")).select("site", F.col("window.start").alias("start"), "scans", "alerts")
