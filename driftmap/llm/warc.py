"""WARC derivatives: each response gives a metadata and a plain-text conversion record.

Both refer to the response by its record id, target URI and date. The metadata block
carries what the source record has: its payload digest and every line of its HTTP header.
Records are made one response at a time inside Spark tasks, in one pass and without a
shuffle; they can be written as WARC/1.1 files and read back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of pages, which hold no capture time and no header of their own.
CAPTURED = "2024-01-01T00:00:00Z"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Responses whose records are made at once, and records of a written file at most.
SLICE, FILE_RECORDS = 64, 50_000

_SKIPPED = r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->"
_BLOCKS = r"(?i)<(?:br|/?(?:p|div|li|ul|ol|tr|table|nav|article|section|header|footer|h[1-6]|body|html|blockquote|pre))\b[^>]*>"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
_LINK = r"(?i)<a\b[^>]*\bhref\s*="
_skipped, _blocks, _title, _link, _tag = (re.compile(p) for p in (_SKIPPED, _BLOCKS, _TITLE, _LINK, r"<[^>]*>"))
_run, _lines = re.compile(r"[ \t\r\f\x0B]+"), re.compile(r" ?\n[ \n]*")
_SCHEMA = (
    "page_id {page}, record_type string, record_id string, refers_to string, refers_to_target_uri string, refers_to_date string, "
    "source_digest string, content_type string, content_length bigint, block_digest string, block string, head string"
)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def record_id(*parts: str | None) -> str:
    """A <urn:uuid:...> that follows from the parts; nulls count as empty."""
    return f"<{uuid.UUID(hashlib.md5(chr(10).join(p or '' for p in parts).encode()).hexdigest()).urn}>"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def html_text(page: str) -> str:
    """The text of a page: scripts, styles, the head and comments go, blocks become lines, references become characters."""
    text = _tag.sub("", _blocks.sub("\n", _skipped.sub(" ", page)))
    return _lines.sub("\n", _run.sub(" ", html.unescape(text).replace("\xa0", " "))).strip(" \n")


def metadata_block(payload: str, text: str, source_digest: str, http: str | None) -> str:
    """The fields of a metadata record: what was found in the payload, and the source's digest and header lines."""
    found = _title.search(payload)
    fields = [
        ("title", re.sub(r"[ \t\r\n\f\x0B]+", " ", html.unescape(found[1]) if found else "")),
        ("outlinks", len(_link.findall(payload))),
        ("text-bytes", len(text.encode())),
        ("source-payload-digest", source_digest),
    ]
    status, *lines = [x for x in (http or "").split("\r\n") if x] or [""]
    fields += [("source-status", status), *(("source-header", x) for x in lines)]
    return "".join(f"{name}: {value}\r\n" for name, value in fields)


def record_head(kind: str, ident: str, refers_to: str, uri: str | None, date: str | None, content_type: str, block: bytes) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", f"WARC-Refers-To: {refers_to}"]
    if uri is not None:
        lines += [f"WARC-Target-URI: {uri}", f"WARC-Refers-To-Target-URI: {uri}"]
    if date is not None:
        lines += [f"WARC-Date: {date}", f"WARC-Refers-To-Date: {date}"]
    lines += [f"WARC-Block-Digest: {digest(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [*[pa.string()] * 7, pa.int64(), *[pa.string()] * 3]
    for b in (whole.slice(lo, SLICE) for whole in batches for lo in range(0, len(whole), SLICE)):
        rows = []
        for source, uri, date, http, payload in zip(*(b.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http", "payload")), strict=True):
            payload = payload or ""
            text, of_source = html_text(payload), digest(payload.encode())
            for name, content_type, block in (("metadata", "application/warc-fields", metadata_block(payload, text, of_source, http)), ("conversion", "text/plain; charset=utf-8", text)):
                ident, raw = record_id(name, source), block.encode()
                rows.append((name, ident, source, uri, date, of_source, content_type, len(raw), digest(raw), block, record_head(name, ident, source, uri, date, content_type, raw)))
        cols = zip(*rows, strict=True) if rows else [()] * len(types)
        page = b.column("page_id").take(pa.array([i for i in range(len(b)) for _ in range(2)], pa.int64()))
        yield pa.RecordBatch.from_arrays([page, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], _NAMES)


def responses(pages: DataFrame, captured: str = CAPTURED, http: str = HTTP_HEAD) -> DataFrame:
    """Response records of pages: page_id, record_id, target_uri, date, http, payload. A null html is an empty payload."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ident = _uuid(F.md5(F.concat_ws("\n", F.lit("response"), text("page_id"), text("url"))))
    return pages.select("page_id", ident.alias("record_id"), F.col("url").alias("target_uri"), F.lit(captured).alias("date"), F.lit(http).alias("http"), text("html").alias("payload"))


def _uuid(h: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def derivatives(found: DataFrame) -> DataFrame:
    """Two records for each response: metadata and conversion.

    found: page_id, record_id, target_uri, date, http (status and header lines), payload;
    other columns are ignored. The result: page_id, record_type, record_id, refers_to,
    refers_to_target_uri, refers_to_date, source_digest (of the payload), content_type,
    content_length (in bytes), block_digest, block, head. A null or empty payload, or one
    without text, has an empty conversion block; a null URI or date leaves its headers out.
    Repeated responses give repeated records. page_id is of any type. A task holds the
    records of SLICE responses.
    """
    page = found.schema["page_id"].dataType
    cols = ["page_id", *(F.col(c).cast("string").alias(c) for c in ("record_id", "target_uri", "date", "http", "payload"))]
    return found.select(*cols).mapInArrow(_derive, _SCHEMA.format(page=page.simpleString()))


def write_warc(records: DataFrame, path: str, most: int = FILE_RECORDS) -> None:
    """Write records (columns head and block) as WARC/1.1 files of at most so many records."""
    records.select(F.concat("head", "block")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(path)


def frames(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, by the lengths that the headers give. A gzipped file is unpacked. Raises ValueError where a record is cut off."""
    data, at = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        version, *lines = data[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not version.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}, or its header is cut off")
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = next((v for k, v in headers.items() if k.lower() == "content-length"), "")
        begin = end + 4
        at = begin + int(size) + 4 if size.isdigit() else len(data) + 1
        if at > len(data) or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"a record is cut off: {headers}")
        yield headers, data[begin : at - 4]


def _framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    for b in batches:
        for content in b.column("content"):
            rows = []
            for headers, block in frames(content.as_buffer().to_pybytes()):
                rows.append((list(headers.items()), block.decode("utf-8", "replace"), block))
                if len(rows) == SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["headers", "block", "content"])
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], ["headers", "block", "content"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers (a map), block (as text; bytes that aren't UTF-8 are replaced), content (its bytes) of the records of WARC files, plain or gzipped.

    Records are framed by Content-Length, so blocks may hold anything. An error is raised
    where a record is cut off. A task holds one file.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_framed, "headers map<string,string>, block string, content binary")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _sql_references(x: str) -> str:
    """Character references by the table of the standard library; numbers by code point, those of 128 to 159 by that table too."""
    table = dict(html5) | {f"#{n};": html.unescape(f"&#{n};") for n in range(128, 160)}
    names = f"map([{', '.join(map(_quoted, table))}], [{', '.join(map(_quoted, table.values()))}])"
    short = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
    name = r"regexp_extract(p, '^(#[0-9]+;?|[^ <&#;\t\n\f]{1,32};?)')"
    start = f"regexp_extract(p, '^({short})')"
    one = (
        f"CASE WHEN {name} <> '' AND len(refs[{name}]) > 0 THEN refs[{name}] || substr(p, len({name}) + 1)"
        f" WHEN regexp_matches(p, '^#[0-9]+') THEN chr(CAST(regexp_extract(p, '^#([0-9]+)', 1) AS INTEGER)) || regexp_replace(p, '^#[0-9]+;?', '')"
        f" WHEN {start} <> '' THEN refs[{start}] || substr(p, len({start}) + 1) ELSE '&' || p END"
    )
    pieces = f"string_split({x}, '&')"
    return f"(SELECT {pieces}[1] || coalesce(array_to_string(list_transform({pieces}[2:], lambda p: {one}), ''), '') FROM (SELECT {names} AS refs) names)"


def _sql_digest(x: str) -> str:
    bits = f"CAST(('0x' || substr(sha1({x}), 1 + 5 * (i // 4), 5)) AS INTEGER)"
    return f"'sha1:' || array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({bits} >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '')"


def _sql_id(*parts: str) -> str:
    h = "md5(" + " || chr(10) || ".join(parts) + ")"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_TAGS = r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->"
_PLAIN = f"regexp_replace(regexp_replace(regexp_replace(p, '(?is){_TAGS}', ' ', 'g'), '{_BLOCKS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
OP3_SQL = rf"""
WITH r AS (SELECT page_id, {_sql_id("'response'", "CAST(page_id AS VARCHAR)", "coalesce(url, '')")} AS refers_to, url, coalesce(html, '') AS p FROM pages),
u AS (SELECT *, {_sql_references(_PLAIN)} AS plain, {_sql_references(f"coalesce(regexp_extract(p, '{_TITLE}', 1), '')")} AS title FROM r),
t AS (SELECT page_id, refers_to, url, p, regexp_replace(title, '[ \t\r\n\f\x0B]+', ' ', 'g') AS title, {_sql_digest("p")} AS source_digest,
      trim(regexp_replace(regexp_replace(replace(plain, chr(160), ' '), '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text,
      len(regexp_extract_all(p, '{_LINK}')) AS links FROM u),
b AS (SELECT page_id, refers_to, url, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
      concat('title: ', title, chr(13), chr(10), 'outlinks: ', links, chr(13), chr(10), 'text-bytes: ', strlen(text), chr(13), chr(10), 'source-payload-digest: ', source_digest, chr(13), chr(10),
      'source-status: HTTP/1.1 200 OK', chr(13), chr(10), 'source-header: Content-Type: text/html; charset=utf-8', chr(13), chr(10)) AS block FROM t
      UNION ALL SELECT page_id, refers_to, url, source_digest, 'conversion', 'text/plain; charset=utf-8', text FROM t),
o AS (SELECT page_id, record_type, {_sql_id('record_type', 'refers_to')} AS record_id, refers_to, url AS refers_to_target_uri, '{CAPTURED}' AS refers_to_date,
      source_digest, content_type, strlen(block) AS content_length, {_sql_digest("block")} AS block_digest, block FROM b)
SELECT *, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: ' || record_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to,
       'WARC-Target-URI: ' || refers_to_target_uri, 'WARC-Refers-To-Target-URI: ' || refers_to_target_uri, 'WARC-Date: ' || refers_to_date, 'WARC-Refers-To-Date: ' || refers_to_date,
       'WARC-Block-Digest: ' || block_digest, 'Content-Type: ' || content_type, 'Content-Length: ' || content_length, chr(13) || chr(10)) AS head
FROM o
"""
