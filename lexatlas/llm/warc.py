"""WARC archives: a distributed writer with revisit records and a reader that salvages damaged files."""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_or_shuffled

VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
MAGIC = b"\x1f\x8b\x08"
#: A gzip member without content. Spark's text writer ends every row with a separator byte; a row of a compressed
#: archive is a record's member and this member without its last byte, which the separator supplies.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
#: No archive that is written is larger (readers hold one in memory).
MOST_BYTES = 256 << 20
#: No gzip member that is read may expand to more.
MOST_EXPANDED = 256 << 20
SCHEMA = (
    "path string, offset long, length long, kind string, reason string, warc_type string, page_id long, target_uri string, "
    "refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def write_archives(pages: DataFrame, path: str, compress: bool = True, min_payload: int = 100, archive_bytes: int = 16 << 20) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) into archives of about ``archive_bytes`` under ``path``, and of at
    most MOST_BYTES, were all records as long as the longest (or of one record).

    The payload is the html in UTF-8 (null: empty) behind an HTTP head. Of records with equal payloads of at least
    ``min_payload`` bytes that with the smallest page_id is a response and the others revisit it; all others are
    responses. A null page_id counts as the largest. Payloads are not shuffled: only digests are grouped, and digests
    that repeat are joined back (broadcast while they are few).
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select("page_id", F.coalesce(F.regexp_replace("url", r"[\x00-\x20]+", "%20"), F.lit("about:blank")).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body").cast("long"))
    per = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"), F.max("size").alias("size"), F.sum(F.octet_length("url").cast("long")).alias("urls"))
    per = materialize(per)
    total, n, most = per.agg(F.sum(F.col("n") * F.col("size") + F.col("urls")), F.sum("n"), F.max(F.col("size") + F.col("urls"))).first()
    repeats = small_or_shuffled(materialize(per.where((F.col("n") > 1) & (F.col("size") >= min_payload) & F.col("first_id").isNotNull()).select("digest", "first_id")))
    rows = rows.join(repeats, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), name("first_id"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string"), F.lit("\r\n\r\n"),
    )
    records = rows.select(F.concat(head.cast("binary"), http.cast("binary"), F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("body"))).alias("value"))
    separator = "\r\n\r\n"
    if compress:

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"value": [gzip.compress(bytes(v) + b"\r\n\r\n", 1, mtime=0) + EMPTY_MEMBER[:-1] for v in pdf["value"]]})

        records, separator = records.mapInPandas(members, "value binary"), EMPTY_MEMBER[-1:].decode("latin-1")
    per_file = max(1, min(int(archive_bytes // max(1, (total or 0) / max(n or 1, 1))), MOST_BYTES // max(1, most or 1)))
    records.select(F.col("value").cast("string")).write.option("lineSep", separator).option("maxRecordsPerFile", per_file).text(path)


class BadRecord(ValueError):
    pass


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at``, and its end; BadRecord if a check fails."""
    if not data.startswith(VERSIONS, at):
        raise BadRecord("no version line")
    head: dict[bytes, bytes] = {}
    begin = at + len(VERSIONS[0])
    while True:  # lines of any length, up to an empty one; a version line or one that is no field ends a damaged header
        stop = data.find(b"\r\n", begin)
        if stop < 0 or data.startswith(VERSIONS, begin):
            raise BadRecord("unended header")
        line, begin = data[begin:stop], stop + 2
        if not line:
            break
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("bad header line")
        head[name.strip().lower()] = value.strip()
    kind = head.get(b"warc-type", b"").decode("latin-1")
    if not kind or not head.get(b"content-length", b"").isdigit():
        raise BadRecord("no type or length")
    end = begin + int(head[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise BadRecord("wrong length")
    block = data[begin:end]
    size, payload = len(block), block
    if head.get(b"content-type", b"").startswith(b"application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        for line in http.split(b"\r\n")[1:]:
            if line.lower().startswith(b"content-length:") and line[15:].strip().isdigit():
                size = int(line[15:])
    digest = head.get(b"warc-payload-digest", b"").decode("latin-1")
    if kind != "revisit":
        if size != len(payload):
            raise BadRecord("wrong payload length")
        if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise BadRecord("wrong digest")
    number = lambda v: int(v[10:-1]) if v and v[:10] == b"<urn:page:" and v[10:-1].lstrip(b"-").isdigit() else None
    record = {
        "warc_type": kind, "page_id": number(head.get(b"warc-record-id")), "target_uri": head.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
        "refers_to": number(head.get(b"warc-refers-to")), "payload_bytes": size, "payload_digest": digest[7:] if digest.startswith("sha256:") else hashlib.sha256(payload).hexdigest(), "payload": payload,
    }
    return record, end + 4


def _member(data: memoryview, at: int, most: int) -> tuple[bytes, int | None, str]:
    """Content of the gzip member that starts at ``at``, its end, and why it is damaged: then the content is what could be
    read, and there is no end."""
    reader, parts, size, fed = zlib.decompressobj(31), [], 0, at
    while not reader.eof:
        chunk, failed = data[fed : fed + (1 << 16)], ""
        if not len(chunk):
            failed = "cut member"
        else:
            try:
                parts.append(reader.decompress(chunk, most - size + 1))
                size += len(parts[-1])
                failed = "member too large" if size > most else ""
            except zlib.error:
                failed = "bad member"
        if failed:
            return b"".join(parts), None, failed
        fed += len(chunk)
    return b"".join(parts), fed - len(reader.unused_data), ""


def _plain(data: bytes, at: int) -> Iterator[dict]:
    """Records and gaps of uncompressed data from ``at`` on."""
    while at < len(data):
        try:
            record, end = _parse(data, at)
            yield {"kind": "record", "offset": at, "length": end - at} | record
        except BadRecord as e:
            end = data.find(b"WARC/1.", at + 1)
            while end >= 0:
                try:
                    _parse(data, end)
                    break
                except BadRecord:
                    end = data.find(b"WARC/1.", end + 1)
            end = len(data) if end < 0 else end
            yield {"kind": "gap", "reason": str(e), "offset": at, "length": end - at}
        at = end


def _inside(content: bytes, damaged: str) -> list[dict]:
    """What a member holds. Of a damaged one only records that another one follows count: its end proves nothing."""
    rows = list(_plain(content, 0))
    if damaged:
        last = max((r["offset"] for r in rows if r["kind"] == "record"), default=0)
        rows = [r for r in rows if r["offset"] < last or r["kind"] == "record" and content.startswith(b"WARC/1.", r["offset"] + r["length"])]
    return rows


def scan(data: bytes, most: int = MOST_EXPANDED) -> Iterator[dict]:
    """Records and gaps of an archive in order. A record whose checks fail, and whatever else lies between records, is
    a gap up to the next place where a whole valid record, or gzip member with one, starts.

    A gzip member may hold any number of records. They all have the member's offset, and the first its length, the others
    none; gaps in its content are told in their reason, by the content's bytes. Of a damaged or cut member the records
    before the damage are read, and the member is a gap. ``most``: bytes that a member may expand to; a larger one counts as damaged there.
    """
    view = memoryview(data)

    def valid(at: int) -> tuple[list[dict], int | None, str]:
        """Rows, end, and what is wrong with what starts at ``at``."""
        if not data.startswith(MAGIC, at):
            try:
                record, end = _parse(data, at)
                return [{"kind": "record"} | record], end, ""
            except BadRecord as e:
                return [], None, str(e)
        content, end, damaged = _member(view, at, most)
        rows = _inside(content, damaged)
        if len(rows) == 1 and rows[0]["kind"] == "gap":
            return [], None, rows[0]["reason"]
        for r in rows:
            if r["kind"] == "gap":
                r["reason"] += f" at bytes {r['offset']} to {r['offset'] + r['length']} of the member"
        return rows, end, damaged

    at = 0
    while at < len(data):
        rows, end, reason = valid(at)
        for i, row in enumerate(rows):
            yield row | {"offset": at, "length": end - at if end and i == 0 else 0}
        if end is None:
            end = at
            while True:
                found = [p for p in (data.find(MAGIC, end + 1), data.find(b"WARC/1.", end + 1)) if p >= 0]
                end = min(found, default=len(data))
                if end == len(data):
                    break
                inner, stop, _ = valid(end)
                if stop is not None or inner:
                    break
            yield {"kind": "gap", "reason": reason, "offset": at, "length": end - at}
        at = end


def read_archives(spark: SparkSession, path: str, payloads: bool = True, most: int = MOST_EXPANDED) -> DataFrame:
    """Records (kind 'record') and quarantined byte ranges (kind 'gap', with the failed check as reason) of the archives
    under ``path``, plain or compressed record by record or in larger members, mixed or damaged (``scan``). An archive is held by one task
    (Spark's reader of binary files hands them over whole), so archives
    should be of bounded size, as the writer's are, and at most 2 GB. An empty file gives no row; payload is null if not asked for."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                rows, held = [], 0
                for row in scan(bytes(content), most):
                    held += row.get("payload_bytes", 0)
                    if not payloads:
                        row.pop("payload", None)
                    rows.append(row | {"path": file})
                    if payloads and held > 8 << 20 or len(rows) >= 5000:
                        yield _frame(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(read, SCHEMA)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({n: [r.get(n) for r in rows] for n in names})
    for n in ("offset", "length", "page_id", "refers_to", "payload_bytes"):
        out[n] = out[n].astype("Int64")
    return out


def archive_pages(pages: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Write ``pages`` to archives under ``path``, read them back, and return per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to, archive and byte_offset.

    Bytes and digest are of the full payload (for a revisit as its record states them). Null html is an empty payload;
    rows that repeat a page_id with equal long payloads are all responses, else revisits of the smallest page_id; a
    null url becomes about:blank; an empty table gives an empty result; further columns are ignored.
    """
    write_archives(pages, path, compress)
    found = read_archives(pages.sparkSession, path, payloads=False).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", F.col("path").alias("archive"), F.col("offset").alias("byte_offset"))
