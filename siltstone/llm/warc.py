"""WARC derivatives: from each response record a metadata record and a plain-text conversion record.

Both refer to the response by its identifier (WARC-Refers-To, with its address and date), the metadata record carries
the response's HTTP headers, digests and links, and the two are tied to each other by WARC-Concurrent-To.
Identifiers are derived from what a record is about, so a job that runs twice makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table
from siltstone.llm.html_text import elements, parse, render_tree

VERSION = "WARC/1.1"
#: Bytes of a file that are expanded at a time, and bytes of blocks that are handed on together.
CHUNK, BATCH = 1 << 20, 16 << 20
RECORD = "record_type string, record_id string, refers_to string, target_uri string, date string, headers array<struct<name:string,value:string>>, block binary"
#: Namespace of derived record identifiers.
NAMESPACE = uuid.UUID("9a3c1f0e-5b1d-4a53-8f5e-0c6f5d1b7a11")

_BLANKS = re.compile(r"\s+")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    """The labelled digest form of the format: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, about: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {about}')}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response; without an empty line all of it is body."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    return first, [(n.strip(), v.strip()) for n, _, v in (x.partition(":") for x in rest) if n], body


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """Visible text, title and link targets of a page, from its tree."""
    root = parse(page)
    title, links = None, []
    for node in elements(root):
        if node.tag == "title" and title is None:
            title = _BLANKS.sub(" ", "".join(x for x in node.children if isinstance(x, str))).strip()
        elif node.tag == "a" and (target := node.attributes.get("href", "").strip()):
            links.append(target)
    return render_tree(root), title, links


def derive_record(response_id: str, target_uri: str, date: str, block: bytes) -> list[tuple]:
    """The conversion and the metadata record of a response, as rows of RECORD."""
    status, http, body = split_http(block)
    fields = {n.lower(): v for n, v in reversed(http)}
    named = _CHARSET.search(fields.get("content-type", ""))
    try:
        page = body.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    shown, title, links = read_page(page)
    text = shown.encode("utf-8", "replace")
    conversion, metadata = record_id("conversion", response_id), record_id("metadata", response_id)
    source = [("WARC-Refers-To", response_id), ("WARC-Refers-To-Target-URI", target_uri), ("WARC-Refers-To-Date", date)]
    lines = [("source-status", status), *[(f"source-header-{n.lower()}", v) for n, v in http]]
    lines += [("source-block-digest", digest(block)), ("source-payload-digest", digest(body)), ("conversion-digest", digest(text))]
    lines += [("title", title)] * (title is not None) + [("outlink", x) for x in links]
    about = "".join(f"{n}: {v}\r\n" for n, v in ((n, v.replace("\r", " ").replace("\n", " ")) for n, v in lines)).encode("utf-8", "replace")
    out = []
    for kind, own, other, content, data in (("conversion", conversion, metadata, "text/plain; charset=utf-8", text), ("metadata", metadata, conversion, "application/warc-fields", about)):
        headers = [*source, ("WARC-Concurrent-To", other), ("Content-Type", content), ("WARC-Block-Digest", digest(data)), ("WARC-Source-Payload-Digest", digest(body))]
        out.append((kind, own, response_id, target_uri, date, headers, data))
    return out


def serialize(kind: str, own: str, target_uri: str, date: str, headers: list, block: bytes) -> bytes:
    """One record as bytes. Line ends inside header values become blanks."""
    first = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Target-URI", target_uri), ("WARC-Date", date)]
    lines = [f"{n}: {' '.join(str(v).splitlines())}" for n, v in [*first, *[(h[0], h[1]) for h in headers], ("Content-Length", len(block))]]
    return "\r\n".join([VERSION, *lines]).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def plain_chunks(data: bytes) -> Iterator[bytes]:
    """A WARC file's bytes in pieces of about CHUNK; a gzip file (one member a record, or all in one) is expanded piece by piece."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), CHUNK):
            yield data[at : at + CHUNK]
        return
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(data):
            rest = view[at : at + CHUNK]
            yield member.decompress(rest, CHUNK)
            while member.unconsumed_tail and not member.eof:
                yield member.decompress(member.unconsumed_tail, CHUNK)
            at += len(rest) - len(member.unused_data)


def parse_warc(chunks: Iterable[bytes]) -> Iterator[dict]:
    """Records of a WARC file's bytes, one by one: no more than a record and a piece are held. Bytes between records are skipped; a
    record that the end cuts is left out if its headers are cut, else its block is short."""
    source, buffer, ended = iter(chunks), bytearray(), False

    def more() -> bool:
        nonlocal ended
        piece = next(source, None)
        ended = piece is None
        buffer.extend(piece or b"")
        return not ended

    while True:
        while (start := buffer.find(b"WARC/1.")) < 0:
            del buffer[: max(0, len(buffer) - 6)]
            if not more():
                return
        del buffer[:start]
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        names = [x.partition(":") for x in buffer[:end].decode("utf-8", "replace").split("\r\n")[1:]]
        headers = [(n.strip(), v.strip()) for n, _, v in names]
        known = {n.lower(): v for n, v in reversed(headers)}
        size = known.get("content-length", "")
        size = int(size) if size.isascii() and size.isdecimal() else 0
        while len(buffer) < end + 4 + size and more():
            pass
        block = bytes(buffer[end + 4 : end + 4 + size])
        del buffer[: end + 4 + size]
        yield {
            "record_type": known.get("warc-type"), "record_id": known.get("warc-record-id"), "refers_to": known.get("warc-refers-to"),
            "target_uri": known.get("warc-target-uri"), "date": known.get("warc-date"),
            "headers": [(n, v) for n, v in headers if n.lower() not in ("warc-type", "warc-record-id", "warc-target-uri", "warc-date", "content-length")], "block": block,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORD from WARC files (a folder or pattern). A file is read by one task, which holds its stored bytes and hands its records
    on in batches of about BATCH bytes of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows, held = [], 0
                for row in parse_warc(plain_chunks(bytes(data))):
                    rows.append(row)
                    held += len(row["block"])
                    if held >= BATCH or len(rows) >= 1_000:
                        yield pd.DataFrame(rows)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)


def warc_bytes(records: DataFrame, compress: bool = True) -> DataFrame:
    """(record_id, data binary): each row of RECORD as the bytes of a record, by default a gzip member of its own; members
    put one after another are a WARC file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["record_type"], b["record_id"], b["target_uri"], b["date"], b["headers"], b["block"], strict=True)
            data = [serialize(k, i, u or "", d or "", [(h["name"], h["value"]) for h in hs], bytes(x)) for k, i, u, d, hs, x in rows]
            yield pd.DataFrame({"record_id": b["record_id"], "data": [gzip.compress(x, 6, mtime=0) for x in data] if compress else data})

    return records.mapInPandas(run, "record_id string, data binary")


def derivatives(responses: DataFrame, serialized: bool = False) -> DataFrame:
    """Two rows of RECORD (conversion, metadata) per response. responses: record_id, target_uri, date, block; further columns
    aren't read. Null blocks count as empty, null addresses and dates as empty strings; a null record_id is
    derived from address and date. Repeated responses give repeated records. No response, no record. Very long and very deep
    pages are converted whole; a task holds a page and its tree. serialized adds record_length and record_crc32 of the records as
    serialize() gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for own, uri, date, block in zip(b["record_id"], b["target_uri"], b["date"], b["block"], strict=True):
                rows += derive_record(own or record_id("response", f"{uri} {date}"), uri or "", date or "", bytes(block or b""))
            if rows:
                out = pd.DataFrame(rows, columns=["record_type", "record_id", "refers_to", "target_uri", "date", "headers", "block"])
                out["headers"] = [[{"name": n, "value": v} for n, v in h] for h in out["headers"]]
                if serialized:
                    whole = [serialize(kind, own, uri, date, headers, data) for kind, own, _, uri, date, headers, data in rows]
                    out["record_length"], out["record_crc32"] = [len(x) for x in whole], [zlib.crc32(x) for x in whole]
                yield out

    return responses.select("record_id", "target_uri", "date", "block").mapInPandas(run, RECORD + ", record_length long, record_crc32 long" * serialized)


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as response records, with page_id. The pages have no date: a fixed one stands for it."""
    page = F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"))
    about = F.sha2(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), "url"), 256)
    dashes = F.concat_ws("-", *[F.substring(about, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), dashes, F.lit(">")).alias("record_id"), F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.concat(head, page).cast("binary").alias("block"),
    )


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per derived record: what it is and refers to, its lengths and digests, and length and CRC of its serialised form."""
    records = derivatives(responses_of_pages(table(spark, sf_dir, "pages")), serialized=True)
    header = lambda name: F.get(F.filter("headers", lambda h: h["name"] == name), 0)["value"]
    return records.select(
        "record_type", "record_id", "refers_to", "target_uri", header("WARC-Concurrent-To").alias("concurrent_to"), F.size("headers").alias("n_headers"),
        F.octet_length("block").cast("long").alias("length"), header("WARC-Block-Digest").alias("block_digest"), header("WARC-Source-Payload-Digest").alias("source_digest"),
        "record_length", "record_crc32",
    )
