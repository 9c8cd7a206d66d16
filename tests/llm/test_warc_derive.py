import base64
import hashlib
import json
import random
import time

from crawlspark.llm import warc_derive as w

PAGE = """<!DOCTYPE html><html><head><title>The &amp; title</title><style>p { x: "<b>" }</style></head>
<body><!-- <p>hidden</p> --><h1>Head</h1><p>One <b>bold</b>   word<br>next</p><script>if (a < b) { "</p>" }</script>
<a class=x href="/a?b=1&amp;c=2">link</a> <a name=n>none</a> <A HREF='two'>2</A> 3 &lt; 4</body></html>"""


def test_reads_a_page():
    title, text, links = w.read_page(PAGE)
    assert title == "The & title"
    assert text.split("\n") == ["Head", "One bold word", "next", "link none 2 3 < 4"]
    assert links == ["/a?b=1&c=2", "two"]


def test_broken_pages_are_read_once():
    for bit in ("<", "<a", "<!--", "<script>", "<p ", "</", "<title>", "&", "<a href='", "<svg/>", "<script/"):
        seconds = []
        for n in (20_000, 200_000):
            page = bit * n
            t = time.perf_counter()
            w.read_page(page)
            seconds.append(time.perf_counter() - t)
        assert seconds[1] < 40 * max(seconds[0], 0.01), bit


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_warc(data):
    """Records of a WARC file: (header fields, block)."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block = data[end + 4: end + 4 + size]
        assert data[end + 4 + size: end + 8 + size] == b"\r\n\r\n"
        yield fields, block
        at = end + 8 + size


def test_records_are_linked_and_written(spark, tmp_path):
    rng = random.Random(1)
    pages = [(1, "http://a.test/x", PAGE), (2, None, None), (3, "http://b.test/\r\nX: y", "<p>ünï\r\n\r\ntext " + "long " * 50000), (4, "", "")]
    pages += [(10 + i, f"http://c.test/{i}", "<p>" + " ".join(rng.choice(["a", "é", "&lt;"]) for _ in range(50))) for i in range(40)]
    pages.append(pages[0])
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, block string")
    responses = w.responses(df)
    sources = {r.page_id: r for r in responses.collect()}
    derived = w.derive(responses)
    rows = derived.collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        source, fields = sources[r.page_id], w.header_fields(r.warc_header)
        assert r.refers_to == fields["warc-refers-to"] == source.record_id == w.header_fields(source.warc_header)["warc-record-id"]
        assert fields["warc-type"] == r.warc_type and fields["warc-record-id"] == r.record_id
        assert fields["warc-refers-to-date"] == w.CAPTURED
        raw = r.block.encode()
        assert r.block_digest == fields["warc-block-digest"] == sha1(raw) and r.content_length == int(fields["content-length"]) == len(raw)
        assert r.source_payload_digest == sha1(source.payload.encode())
        if r.warc_type == "metadata":
            kept = json.loads(r.block)["source"]
            assert kept["warc-header"] == source.warc_header.split("\r\n") and kept["http-header"] == source.http_header.split("\r\n")
        else:
            assert r.block == w.read_page(source.payload)[1]
    assert len({r.record_id for r in rows}) == 2 * (len(pages) - 1)
    path = str(tmp_path / "warc")
    w.write_warc(derived.repartition(3), path, compression="none")
    read = [x for f in sorted((tmp_path / "warc").glob("part-*")) for x in parse_warc(f.read_bytes())]
    assert sorted((f["WARC-Record-ID"], b) for f, b in read) == sorted((r.record_id, r.block.encode()) for r in rows)


def test_foreign_records_and_empty_table(spark):
    head = "WARC/1.0\r\nWARC-Date: 2020-02-02T00:00:00Z\r\nWARC-Payload-Digest: sha1:KEPT\r\nX-Own: 1"
    df = spark.createDataFrame([(1, "<urn:uuid:1>", "http://x", head, "HTTP/1.1 200 OK\r\nServer: s", "<p>t</p>"), (2, None, None, None, None, None)],
                               "page_id bigint, record_id string, target_uri string, warc_header string, http_header string, payload string")
    rows = w.derive(df).filter("page_id = 1 and warc_type = 'metadata'").collect()
    assert rows[0].source_payload_digest == "sha1:KEPT" and "X-Own: 1" in rows[0].block and "Server: s" in rows[0].block
    assert w.derive(df.limit(0)).collect() == []
    assert w.derive(df).count() == 4
