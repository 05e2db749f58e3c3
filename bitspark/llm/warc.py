"""WARC archives: writing pages as records, reading them back, and assembling transactions.

A capture is a response (or a revisit of an equal payload), a request and a metadata record; the latter
two name the first by ``WARC-Concurrent-To``.  Records are made by SQL expressions and written by Spark's
text writer with ``CRLF CRLF`` as its separator, so the archives go wherever Spark can write.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored

CRLF = "\r\n"
#: Bytes of payload that a file holds at most, before compression, unless a single one has more; a file is read as one row, of at most 2 GB.
FILE_BYTES = 1 << 30
#: RFC 4648 base 32 digits, fixed by the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, page_id bigint, uri string, date string, "
    "payload_bytes bigint, payload_digest string, fields string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1 of a string's UTF-8 bytes: 20 bits at a time, through radix 32."""
    digits = F.sha1(F.encode(payload, "UTF-8"))
    groups = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing separator; a header whose value is null is left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), F.concat_ws("", *lines), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def request_text(uri: Column) -> Column:
    """Block of the request for a uri; null is empty."""
    path, host = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.concat(F.lit("GET "), F.coalesce(path, F.lit("")), F.lit(f" HTTP/1.1{CRLF}Host: "), F.coalesce(host, F.lit("")), F.lit(CRLF * 2))


def metadata_text(n: Column) -> Column:
    """Block of the metadata for a payload of ``n`` bytes, a string."""
    return F.concat(F.lit("payloadBytes: "), n, F.lit(CRLF))


def write_warc(pages: DataFrame, path: str, *, dedupe_from: int = 0, date: str = "1970-01-01T00:00:00Z", captures_per_file: int = 1024) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files below ``path``, three records a page.

    A file holds ``captures_per_file`` pages at most, and ``FILE_BYTES`` of payload or one page: pages are written by
    classes of their size, each with as many to a file as surely fit.

    Of pages with equal payloads of ``dedupe_from`` bytes or more, that with the smallest id is a
    response and the others are revisits without payload; repeated rows of that smallest id, and
    pages without id, are responses.  A null html is an empty payload.  Line breaks in a url are
    percent-encoded; a null url or id writes no such header.  Other columns are ignored.
    """
    pages = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.col("html")))
    large = pages.where(F.octet_length("html") >= dedupe_from).select("page_id", "digest").distinct()
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"))
    revisits = Stored(large.join(first, "digest").where("page_id > first"), "revisits")
    rows = pages.join(revisits.df, ["page_id", "digest"], "left")

    n = F.octet_length("html").cast("string")
    uri, rid = F.col("url"), F.when(F.col("first").isNull(), _uuid("response", F.col("page_id"), F.col("digest"))).otherwise(_uuid("revisit", F.col("page_id"), F.col("digest")))
    page = F.col("page_id").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n, F.lit(CRLF * 2))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), ("WARC-Page-ID", page)]
    whole = _record([
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("Content-Type", F.lit("application/http; msgtype=response")),
    ], F.concat(http, "html"))
    again = _record([
        ("WARC-Type", F.lit("revisit")), ("WARC-Record-ID", rid), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _uuid("response", F.col("first"), F.col("digest"))), ("Content-Type", F.lit("application/http; msgtype=response")),
    ], http)
    ask = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http; msgtype=request")),
    ], request_text(uri))
    meta = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", F.col("page_id"), F.col("digest"))), *common, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields")),
    ], metadata_text(n))
    triple = F.array(ask, F.when(F.col("first").isNull(), whole).otherwise(again), meta)
    # how many pages of each size class there are: few classes but the first have any
    size = F.octet_length("html")
    bounds = _size_classes(captures_per_file)
    named = F.coalesce(*[F.when(size <= top, k) for k, (top, _) in enumerate(bounds)])
    there = sorted(r["k"] for r in pages.select(named.alias("k")).distinct().collect()) or [0]
    for k in there:
        records = rows.where(named == k).select(F.explode(triple).alias("value"))
        records.write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * bounds[k][1]).text(path)
    revisits.drop()


def _size_classes(captures: int) -> list[tuple[int, int]]:
    """``(bytes of a payload at most, pages to a file)``: each class has a quarter of the pages of the one before."""
    out = [(FILE_BYTES // captures, captures)]
    while out[-1][1] > 1:
        fewer = max(1, out[-1][1] // 4)
        out.append((FILE_BYTES // fewer if fewer > 1 else 1 << 31, fewer))
    return out if captures > 1 else [(1 << 31, 1)]


def inflated(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Pieces of a file's plain bytes: of all its gzip or zlib members, one after the other, or the file itself if it isn't compressed.

    Standard archives have a member for each record.  A member that breaks off raises ValueError.
    """
    if not content.startswith((b"\x1f\x8b", b"\x78")):
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(content):
        member = zlib.decompressobj(wbits=47)
        while not member.eof:
            if at >= len(content):
                raise ValueError("compressed archive breaks off")
            piece = member.decompress(view[at : at + step])
            at = min(at + step, len(content)) - len(member.unused_data)
            yield piece


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (names in lower case, each with all of its values) and block of each record of an archive's ``inflated`` pieces.

    Blocks are taken by Content-Length, whatever they hold; one record at a time is held.  A header's name
    ends at its first colon; a line that begins with white space goes on with the one before.  Bytes of headers that
    aren't UTF-8 are replaced.  What isn't a record, or has no length, raises ValueError.
    """
    source, held, gone = iter(pieces), bytearray(), 0

    def more() -> bool:
        piece = next(source, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while len(held) < 5 and more():
            pass
        if not held:
            return
        if not held.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {gone}")
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError(f"headers without end at byte {gone}")
        headers: dict[str, list[str]] = {}
        for line in re.sub(r"\r\n[ \t]+", " ", held[:end].decode("utf-8", "replace")).split(CRLF)[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        length = headers.get("content-length", [""])[0]
        if not re.fullmatch(r"[0-9]+", length):
            raise ValueError(f"record without length at byte {gone}")
        stop = end + 4 + int(length)
        while len(held) < stop + 4 and more():
            pass
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record ends without separator at byte {gone + stop}")
        yield headers, bytes(held[end + 4 : stop])
        del held[: stop + 4]
        gone += stop + 4


def _rows(payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                out = []
                for headers, block in parse_records(inflated(content)):
                    h = {k: v[0] for k, v in headers.items()}
                    kind, body, page = h.get("warc-type"), None, h.get("warc-page-id", "")
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2]
                    out.append((
                        h.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), h.get("warc-refers-to"), int(page) if re.fullmatch(r"-?[0-9]{1,19}", page) else None, h.get("warc-target-uri"), h.get("warc-date"),
                        None if body is None else len(body), h.get("warc-payload-digest", "").removeprefix("sha1:") or None if body is None else base64.b32encode(hashlib.sha1(body).digest()).decode(),
                        block.decode("utf-8", "replace") if kind in ("metadata", "request") else None, body if payloads else None,
                    ))
                    if len(out) == 256:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    return run


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype({"page_id": "Int64", "payload_bytes": "Int64"})


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records below ``path``.  Digest and length of a response are of the payload that was read, not of its headers.

    A file is one row of at most 2 GB compressed, and is inflated a record at a time.  Files of other makers are
    read too, with a null page id; a record without id or type has null there, and bytes of headers, requests and metadata
    that aren't UTF-8 are replaced.  An empty folder gives no records.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_rows(payloads), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: ``capture, request, metadata`` structs and ``original``, the response that a revisit refers to.

    Requests and metadata meet their capture by ``concurrent_to``, which either side may have, with as many ids as it likes; of
    several for one capture that with the smallest record id counts, and one whose capture is missing is dropped.  A
    capture without request or metadata, or a revisit without original, has null there; one without an id meets nothing.
    """
    fields = F.struct("record_id", "type", "page_id", "uri", "date", "payload_bytes", "payload_digest", "refers_to", "payload")
    seen = records.where("type in ('response', 'revisit')")
    captures = seen.select("record_id", "refers_to", fields.alias("capture"))
    told = records.where("type in ('request', 'metadata')").select("record_id", "concurrent_to", "type", F.struct("record_id", "date", "fields").alias("part"))
    forward = told.select(F.explode("concurrent_to").alias("record_id"), "type", "part")
    named = seen.select(F.col("record_id").alias("by"), F.explode("concurrent_to").alias("record_id")).where("by is not null")
    backward = told.join(named, "record_id").select(F.col("by").alias("record_id"), "type", "part")
    parts = forward.union(backward).groupBy("record_id").agg(*[F.min(F.when(F.col("type") == k, F.col("part"))).alias(k) for k in ("request", "metadata")])
    originals = records.where("type = 'response'").groupBy("record_id").agg(F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("original"))
    first = captures.where("refers_to is null").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType))
    again = captures.where("refers_to is not null").join(originals.withColumnRenamed("record_id", "refers_to"), "refers_to", "left").select(*first.columns)
    return first.union(again).join(parts, "record_id", "left").select("capture", "request", "metadata", "original")
