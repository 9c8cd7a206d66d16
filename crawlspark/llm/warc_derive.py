"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A derived record names its source in WARC-Refers-To, repeats the source's target and date, and
carries digests of its own block; the metadata record holds the source's header lines, its HTTP
header lines and its digests unchanged.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspark.llm.common import prepare

# the table of pages has no time of capture
CAPTURED = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of URLs

RESPONSES = "page_id bigint, record_id string, target_uri string, warc_header string, http_header string, payload string"
RECORDS = ("page_id bigint, warc_type string, record_id string, refers_to string, target_uri string, "
           "source_payload_digest string, block_digest string, content_length bigint, warc_header string, block string")

# each alternative stops at the next mark or takes all the rest, so a page is read once
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>?|<[!?/][^<>]*>?", re.S)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SILENT = {"script", "style", "noscript", "template", "textarea", "iframe", "svg"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "small", "sub", "sup", "code", "abbr", "font", "mark", "q", "cite"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """The same parts give the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(10).join(parts))}>"


def header_lines(version: str, fields: list[tuple[str, str]]) -> str:
    """Header of a record; line breaks inside a value are percent-encoded."""
    clean = [(n, v.replace("\r", "%0D").replace("\n", "%0A")) for n, v in fields]
    return "\r\n".join([version, *(f"{n}: {v}" for n, v in clean)])


def header_fields(lines: str) -> dict[str, str]:
    """Name (lower-cased) → value of a header's lines; of repeated names the first."""
    fields: dict[str, str] = {}
    for line in lines.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    return fields


def read_page(page: str) -> tuple[str, str, list[str]]:
    """(title, plain text, link targets) of an HTML text, in one pass."""
    out, links, title, at, in_title = [], [], [], 0, False
    low = None
    for m in iter(lambda: _MARK.search(page, at), None):
        (title if in_title else out).append(html.unescape(page[at:m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if name == "title":
            in_title = not m[1]
        elif name in _SILENT and not m[1] and not m[0].endswith("/>"):
            low = low or page.lower()
            end = low.find(f"</{name}", at) if len(low) == len(page) else page.find(f"</{name}", at)
            at = len(page) if end < 0 else end
        elif name == "a" and not m[1]:
            href = _HREF.search(m[3])
            if href:
                links.append(html.unescape(href[1] or href[2] or href[3] or ""))
        if name and name not in _INLINE:
            out.append("\n")
    (title if in_title else out).append(html.unescape(page[at:]))
    lines = (" ".join(line.split()) for line in "".join(out).split("\n"))
    return " ".join("".join(title).split()), "\n".join(line for line in lines if line), links


def responses(pages: DataFrame, captured: str = CAPTURED) -> DataFrame:
    """Response records of crawled pages (page_id, url, html): the input of derive().

    A null url or html is empty. Rows equal in all three give equal records.
    """
    def one(page_id, url, payload) -> tuple:
        url, payload = url or "", payload or ""
        body = payload.encode("utf-8", "surrogatepass")
        http = header_lines("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))])
        block = http.encode() + b"\r\n\r\n" + body
        id_ = record_id("response", str(page_id), url, digest(body))
        head = header_lines("WARC/1.1", [
            ("WARC-Type", "response"), ("WARC-Record-ID", id_), ("WARC-Target-URI", url), ("WARC-Date", captured),
            ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block)),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))])
        return page_id, id_, url, head, http, payload

    prepare(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_each(one, RESPONSES, many=False), RESPONSES)


def _each(make, schema: str, many: bool):
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    fields = [pa.field(n, pa.int64() if k == "bigint" else pa.string()) for n, k in zip(names, kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                made = make(*values)
                rows.extend(made) if many else rows.append(made)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), fields)], schema=pa.schema(fields))

    return run


def derive(records: DataFrame) -> DataFrame:
    """Two records per response: metadata (JSON) and conversion (plain text).

    records: page_id, record_id, target_uri, warc_header, http_header, payload; other columns are not
    looked at. `warc_header` and `block` of a result row are what is written; record identifiers
    follow from the source's, so a repeated run gives the same. Nulls are taken as empty, an empty
    payload gives an empty conversion. Repeated rows give repeated records; an empty table an empty result.
    """
    def both(page_id, source, uri, head, http, payload) -> list[tuple]:
        source, uri, head, http, payload = (v or "" for v in (source, uri, head, http, payload))
        fields = header_fields(head)
        body = payload.encode("utf-8", "surrogatepass")
        source_digest = fields.get("warc-payload-digest") or digest(body)
        title, text, links = read_page(payload)
        meta = json.dumps({
            "source": {"record-id": source, "warc-header": head.split("\r\n"), "http-header": http.split("\r\n"),
                       "payload-digest": source_digest, "block-digest": fields.get("warc-block-digest", ""), "payload-length": len(body)},
            "title": title, "links": links,
        }, ensure_ascii=False)
        rows = []
        ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
        for kind, media, block in (("metadata", "application/json", meta), ("conversion", "text/plain; charset=utf-8", text)):
            raw = block.encode("utf-8", "surrogatepass")
            lines = header_lines("WARC/1.1", [
                ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", source),
                ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", fields.get("warc-date", "")),
                ("WARC-Target-URI", uri), ("WARC-Date", fields.get("warc-date", "")),
                ("WARC-Block-Digest", digest(raw)), ("Content-Type", media), ("Content-Length", str(len(raw)))])
            rows.append((page_id, kind, ids[kind], source, uri, source_digest, digest(raw), len(raw), lines, block))
        return rows

    prepare(records.sparkSession)
    return records.select(F.col("page_id").cast("bigint"), *[F.col(c).cast("string") for c in (
        "record_id", "target_uri", "warc_header", "http_header", "payload")]).mapInArrow(_each(both, RECORDS, many=True), RECORDS)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as WARC files, one per partition, written by Spark: no worker opens a file itself."""
    (records.select(F.concat("warc_header", F.lit("\r\n\r\n"), "block").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path))
