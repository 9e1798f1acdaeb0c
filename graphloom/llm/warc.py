"""WARC archives: writing with segmented records, and reading with segment reassembly.

Archives are real per-record gzip members, written and read by Spark's own sinks and sources, so any store
that Spark reaches will do. A payload over the segment size is cut into a first record and continuation
records. The reader groups continuations by the origin's identifier, orders them by segment number,
verifies the total length, decodes chunked transfer framing and verifies the payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, written

CHUNK = 1024  # bytes of a chunk of the transfer framing
SEGMENT = 4096  # bytes of a record's block; longer blocks go on in continuation records
ARCHIVE = 64_000_000  # bytes of an archive, at most about
RECORD = "record_id string, page_id long, type string, segment int, origin string, total long, refers_to string, digest string, framed boolean, body binary, payload_bytes long, payload_digest string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of bytes, without UDFs: 5 hex digits are 4 base-32 digits."""
    digest = F.sha1(data)
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def _member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return gzip.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[a : a + CHUNK] for a in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of chunked framing; extensions and trailers are skipped, broken framing is an error."""
    out, at = [], 0
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = framed[end + 2 : end + 2 + size]
        if len(part) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk isn't whole")
        out.append(part)
        at = end + 4 + size


def response_members(page_id: int | None, url: str, html: bytes, segment_size: int) -> list[bytes]:
    """Gzip members of a response record, in segments where its block is longer than ``segment_size``."""
    digest, key = _b32(html), hashlib.md5(html).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(html)
    parts = [block[a : a + segment_size] for a in range(0, len(block), segment_size)]
    first = _record_id(page_id, key)
    out = []
    for i, part in enumerate(parts, 1):
        headers: list[tuple[str, object]] = [("WARC-Type", "response" if i == 1 else "continuation"), ("WARC-Record-ID", first if i == 1 else _record_id(page_id, key, i)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url)]
        headers += [("WARC-Payload-Digest", f"sha1:{digest}"), *([("X-Page-ID", page_id)] if page_id is not None else []), ("Content-Type", "application/http; msgtype=response")] if i == 1 else [("WARC-Segment-Origin-ID", first)]
        if len(parts) > 1:
            headers += [("WARC-Segment-Number", i), *([("WARC-Segment-Total-Length", len(block))] if i == len(parts) else [])]
        out.append(_member(headers, part))
    return out


def revisit_member(page_id: int | None, url: str, digest: str, response: int | None, key: str) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", _record_id(page_id, key, "revisit")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(response, key)), *([("X-Page-ID", page_id)] if page_id is not None else []), ("Content-Type", "application/http; msgtype=response")]
    return _member(headers, block)


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, segment_size: int = SEGMENT, archive_size: int = ARCHIVE) -> None:
    """Writes a record per row of ``page_id, url, html`` under ``path``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the smallest page_id (null last) is the
    response and the others revisit it; smaller ones are all responses, and so are rows that repeat the
    response's id. A null html is an empty payload, a null url an empty target. Pages are compressed
    before they meet that decision, so the join moves about as many bytes as the archives have. A record is at
    most a segment, so the number of records bounds an archive's bytes. Other columns of ``pages`` don't matter; an
    empty table gives archives without records.
    """
    size, sha = F.octet_length(F.coalesce("html", F.lit(""))), F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    order = F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id"))
    firsts = pages.select("page_id", sha.alias("sha"), size.alias("size")).filter(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                ids, urls, htmls = (b.column(i).slice(a, 256).to_pylist() for i in range(3))
                payloads = [(h or "").encode() for h in htmls]
                members = [response_members(i, u or "", p, segment_size) for i, u, p in zip(ids, urls, payloads, strict=True)]
                columns = [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array([hashlib.sha1(p).hexdigest() for p in payloads]), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.md5(p).hexdigest() for p in payloads]), pa.array(members, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "sha", "size", "key", "members"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                out: list[bytes] = []
                for page_id, url, sha1, key, revisits, first, members in zip(*(b.column(i).slice(a, 256).to_pylist() for i in range(7)), strict=True):
                    own = [revisit_member(page_id, url or "", base64.b32encode(bytes.fromhex(sha1)).decode(), first, key)] if revisits else members
                    if any(m[-1] for m in own):
                        raise ValueError("segments must stay under 16 MiB")
                    out += (m[:-1] for m in own)  # the last byte, zero, is the sink's line separator
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    made = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(responses, "page_id long, url string, sha string, size long, key string, members array<binary>")
    met = made.join(firsts.withColumnRenamed("sha", "s"), F.col("sha") == F.col("s"), "left")
    revisits = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.id")), F.lit(False))
    # a revisit needs no payload of its own
    ready = met.select("page_id", "url", "sha", "key", revisits.alias("revisits"), F.col("first.id").alias("first"), F.when(~revisits, F.col("members")).alias("members"))
    members = ready.mapInArrow(chosen, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").option("maxRecordsPerFile", max(1, archive_size // (segment_size + 1024))).text(path)


def _parsed(content: bytes) -> Iterator[dict]:
    """The records of an archive, member by member; each byte is read once."""
    at, view = 0, memoryview(content)
    while at < len(content):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(content):
                raise ValueError("a record isn't whole")
            parts.append(member.decompress(view[at : at + 16_384]))
            at += min(16_384, len(content) - at)
        at -= len(member.unused_data)
        record = b"".join(parts)
        head, rest = record.split(b"\r\n\r\n", 1)
        version, *lines = head.decode().split("\r\n")
        h = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        length = int(h["content-length"])
        if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
            raise ValueError("a record isn't whole")
        yield h | {"block": rest[:length]}


def _reader(settle: bool):
    """Reads archives into rows; with ``settle`` whole responses are decoded at once and only their size and digest go on, and segments go on compressed."""
    kinds = {"page_id": pa.int64(), "segment": pa.int32(), "total": pa.int64(), "framed": pa.bool_(), "body": pa.binary(), "payload_bytes": pa.int64()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in (f.split(" ")[0] for f in RECORD.split(", "))])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows: list[dict] = []
                held = 0
                for h in _parsed(content.as_buffer().to_pybytes()):
                    kind, block, http = h["warc-type"], h["block"], b""
                    if kind != "continuation" and b"\r\n\r\n" in block:
                        http, block = block.split(b"\r\n\r\n", 1)
                    number = int(h.get("warc-segment-number", 0))
                    row = {
                        "record_id": h["warc-record-id"], "page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "type": kind, "segment": number,
                        "origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None,
                        "refers_to": h.get("warc-refers-to"), "digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                        "framed": b"transfer-encoding: chunked" in http.lower(), "body": http + b"\r\n\r\n" + block if number and http else block,
                    }
                    if settle and not number:
                        payload = _decoded(block, row["framed"], row["digest"]) if kind == "response" else None
                        row |= {"body": None, "payload_bytes": None if payload is None else len(payload), "payload_digest": None if payload is None else row["digest"] or _b32(payload)}
                    if settle and number:
                        row["body"] = zlib.compress(row["body"], 1)
                    rows.append(row)
                    held += len(row["body"] or b"")
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return records


def _decoded(body: bytes, framed: bool, digest: str | None) -> bytes | None:
    """The payload, or None where its framing is broken or its digest isn't the one given."""
    try:
        payload = dechunked(body) if framed else body
    except ValueError:
        return None
    return payload if digest is None or _b32(payload) == digest else None


def _payloads(batches: Iterator[pa.RecordBatch], packed: bool = False) -> Iterator[pa.RecordBatch]:
    """Decodes bodies, whole or in segments (compressed ones if ``packed``), and verifies lengths and digests."""
    for b in (b.slice(a, 64) for b in batches for a in range(0, b.num_rows, 64)):
        out = []
        for row in b.to_pylist():
            body, framed, ok, copies = row["body"], row["framed"], True, 1
            if row["parts"] is not None:
                parts = {p["segment"]: p for p in row["parts"]}
                copies = max(1, sum(p["segment"] == 1 for p in row["parts"]))  # rows that repeat a page repeat its records
                order = sorted(parts)
                body = b"".join(zlib.decompress(parts[i]["body"]) if packed else parts[i]["body"] for i in order)
                total = next((p["total"] for p in row["parts"] if p["total"] is not None), None)
                ok = order == list(range(1, len(order) + 1)) and len(row["parts"]) == copies * len(order) and total == len(body)
                body = body.split(b"\r\n\r\n", 1)[1] if ok else None
            payload = _decoded(body, framed, row["digest"]) if ok else None
            out += [{"record_id": row["record_id"], "page_id": row["page_id"], "payload": payload, "verified": payload is not None}] * copies
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload", pa.binary()), ("verified", pa.bool_())]))


def read_records(spark: SparkSession, path: str, settle: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``; bodies as stored."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_reader(settle), RECORD)


SEGMENTS = "array<struct<segment:int,total:long,body:binary>>"


def reassembled(records: DataFrame) -> DataFrame:
    """Segments grouped by origin: ``record_id, page_id, digest, framed, body (null), parts``."""
    parts = records.filter("segment > 0").groupBy("origin").agg(
        F.first("page_id", ignorenulls=True).alias("page_id"), F.first("digest", ignorenulls=True).alias("digest"), F.max("framed").alias("framed"), F.collect_list(F.struct("segment", "total", "body")).alias("parts")
    )
    return parts.select(F.col("origin").alias("record_id"), "page_id", "digest", "framed", F.lit(None).cast("binary").alias("body"), F.col("parts").cast(SEGMENTS).alias("parts"))


PAYLOAD = "record_id string, page_id long, payload binary, verified boolean"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``record_id, page_id, payload, verified`` of response records, their segments put together.

    Whole records aren't shuffled; only segments are, grouped by origin. The payload is null and ``verified``
    false where a segment is missing, the total length or the digest doesn't hold, or framing is broken.
    """
    records = read_records(spark, path)
    whole = records.filter("segment = 0 and type = 'response'").select("record_id", "page_id", "digest", "framed", "body", F.lit(None).cast(SEGMENTS).alias("parts"))
    return whole.unionByName(reassembled(records)).mapInArrow(_payloads, PAYLOAD)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to``, of the payloads as read back.

    Archives are read once: whole responses are decoded and measured where they are read, segments are kept
    for reassembly. A revisit's size and the page that it refers to come from the response that it names.
    """
    records = written(read_records(spark, path, settle=True), "warc-records")
    whole = records.filter("segment = 0 and type = 'response'").select("record_id", "page_id", "payload_bytes", "payload_digest")
    put_together = reassembled(records).mapInArrow(partial(_payloads, packed=True), PAYLOAD)
    responses = whole.unionByName(put_together.select("record_id", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")))
    revisits = records.filter("type = 'revisit'").select("page_id", "refers_to", "digest")
    named = responses.select("record_id", F.col("page_id").alias("response_id"), "payload_bytes", "payload_digest").distinct()
    again = revisits.join(named, (F.col("refers_to") == F.col("record_id")) & (F.col("digest") == F.col("payload_digest")), "left")
    out = ["page_id", "payload_bytes", "payload_digest"]
    return responses.select(*out, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again.select(*out, F.lit("revisit").alias("record_type"), F.col("response_id").alias("refers_to")))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Every page of the table written as WARC records, in segments where they are long, and read back."""
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, min_revisit_bytes=0)
    return read_pages(spark, path)


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS s FROM pages
), d AS (
  SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s) AS first_id,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS digest
  FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
"""
