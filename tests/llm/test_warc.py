"""WARC derivatives: texts, links between records, and files that come back."""

import base64
import gzip
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from driftmap.llm import warc

PAGE = "<html><head><title>T &amp; x &eacute;</title></head><body><script>var a='<p>';</script><p>One  two</p><p>A &lt; b &hellip; &#8364;&#x41; &notin; &copy 5</p><a href='/x'>l</a></body></html>"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Cache: a: b\r\nServer: s\r\n\r\n"


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://b/", "<p>WARC page\r\n\r\nends\r\n"), (4, "http://c/", "long é " * 60_000)]
    found = warc.responses(spark.createDataFrame(rows, "page_id bigint, url string, html string"), http=HTTP)
    return warc.derivatives(found).cache()


def test_text_and_references():
    assert warc.html_text(PAGE) == "One two\nA < b … €A ∉ © 5\nl"
    assert warc.html_text("") == "" and warc.html_text("<p>&nbsp;</p>") == ""


def test_records_are_linked(records):
    got = {(r.page_id, r.record_type): r for r in records.collect()}
    c, m = got[1, "conversion"], got[1, "metadata"]
    assert c.refers_to == m.refers_to and c.record_id != m.record_id
    for r in got.values():
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id)
        raw = r.block.encode()
        assert r.content_length == len(raw)
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.head and r.head.endswith("\r\n\r\n")
    assert c.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    for line in ("title: T & x é", "outlinks: 1", f"source-payload-digest: {c.source_digest}", "source-status: HTTP/1.1 200 OK", "source-header: Content-Type: text/html", "source-header: X-Cache: a: b", "source-header: Server: s"):
        assert line + "\r\n" in m.block
    assert "WARC-Refers-To-Target-URI: http://a/\r\n" in c.head and "WARC-Refers-To-Date: " in c.head
    assert got[2, "conversion"].block == "" and "Target-URI" not in got[2, "conversion"].head


def test_files_come_back(spark, records, tmp_path):
    warc.write_warc(records.repartition(2), f"{tmp_path}/warc")
    back = {r.headers["WARC-Record-ID"]: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect()}
    wanted = {r.record_id: r for r in records.collect()}
    assert back.keys() == wanted.keys()
    for k, r in wanted.items():
        assert back[k].block == r.block
        assert back[k].headers["WARC-Refers-To"] == r.refers_to and back[k].headers["WARC-Type"] == r.record_type
        assert back[k].headers["WARC-Block-Digest"] == r.block_digest


def test_a_record_that_is_cut_off_raises(spark, records, tmp_path):
    records.filter("page_id = 1").selectExpr("concat(replace(head, 'Content-Length: ', 'Content-Length: 9'), block)").write.option("lineSep", "\r\n\r\n").text(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, f"{tmp_path}/bad").collect()


def test_blocks_may_hold_what_begins_a_record(spark, tmp_path):
    text = "<title>About WARC/1.1\r\nx</title>a\nWARC/1.1\r\nWARC-Type: metadata\r\n\r\nb"
    pages = spark.createDataFrame([(1, "http://x", text), (2, None, "é\r\n\r\n")], "page_id smallint, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    assert records.schema["page_id"].dataType.simpleString() == "smallint"
    records = records.withColumn("block", F.concat("block", F.lit("\r\n\r\nWARC/1.1\r\nX: é\r\n\r\n"))).withColumn("head", F.regexp_replace("head", "Content-Length: .*", F.concat(F.lit("Content-Length: "), F.octet_length("block"))))
    warc.write_warc(records, f"{tmp_path}/w", most=1)
    want = {r.record_id: r.block for r in records.collect()}
    assert {r.headers["WARC-Record-ID"]: r.block for r in warc.read_warc(spark, f"{tmp_path}/w").collect()} == want
    assert len(list((tmp_path / "w").glob("part-*"))) >= 4


def test_gzipped_members_and_bytes():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: 4\r\n\r\n\xff\x00\r\n\r\n\r\n"
    assert [b for _, b in warc.frames(gzip.compress(record) * 3)] == [b"\xff\x00\r\n"] * 3
    for bad in (record[:-1], b"x" + record, record[:20], record.replace(b"content-length: 4", b"X: 1")):
        with pytest.raises(ValueError):
            list(warc.frames(bad))


@pytest.mark.parametrize("kind", ["string", "decimal(10,2)", "date", "boolean"])
def test_ids_of_any_type(spark, kind):
    df = spark.sql(f"select cast(null as {kind}) as page_id, 'u' as url, 'x' as html")
    got = warc.derivatives(warc.responses(df))
    assert got.schema["page_id"].dataType.simpleString() == kind and got.count() == 2


def test_sql_references():
    import duckdb
    import html

    texts = ["a &amp; b &lt;x&gt; &notin; &notit; &copy 5 &copy; &#65; &#x; &unknown; && &", "plain", "&#128;x &eacute;&hellip;", "&amp"]
    for t in texts:
        got = duckdb.execute(f"SELECT {warc._sql_references('p')} FROM (SELECT ? AS p)", [t]).fetchone()[0]
        assert got == html.unescape(t)
