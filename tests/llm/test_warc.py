import base64
import gzip
import hashlib
import html
import random
import re
import time

import pytest

from keelstate.llm import warc as op

PAGE = b"""<html><head><title>A &amp; B</title><style>p {}</style></head>
<body><!-- no --><h1>Head</h1><p>First  para<br>line</p><script>var x = "<p>";</script>
<a href="/x?a=1&amp;b=2">link</a> tail &eacute;</body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, record_id string")


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_records_are_linked(spark):
    source = op.responses(pages(spark, [("http://a/", PAGE.decode())]))
    response = source.first()
    meta, text = sorted(op.derive(source).collect(), key=lambda r: r.warc_type != "metadata")
    assert (meta.warc_type, text.warc_type) == ("metadata", "conversion")
    assert meta.refers_to == text.refers_to == response.record_id
    assert meta.target_uri == text.target_uri == "http://a/" and meta.warc_date == response.warc_date
    assert response.payload_digest == sha1(PAGE) and text.payload_digest == sha1(bytes(text.block))
    assert text.headers["WARC-Source-WARC-Payload-Digest"] == sha1(PAGE)
    assert text.headers["WARC-Source-WARC-Block-Digest"] == response.block_digest
    assert response.block_digest == sha1(bytes(response.block)) and text.block_digest == sha1(bytes(text.block))
    assert bytes(text.block).decode() == "A & B\nHead\nFirst para\nline\nlink tail é"
    assert text.headers["WARC-Source-Content-Type"] == "text/html; charset=utf-8"
    lines = bytes(meta.block).decode().split("\r\n")
    assert "title: A & B" in lines and "outlink: /x?a=1&b=2" in lines and f"conversion: {text.record_id}" in lines
    assert "header-Content-Type: text/html; charset=utf-8" in lines
    assert meta.headers["WARC-Concurrent-To"] == text.record_id
    again = sorted(op.derive(source).collect(), key=lambda r: r.warc_type != "metadata")
    assert [r.record_id for r in again] == [meta.record_id, text.record_id]


def test_files_round_trip(spark, tmp_path):
    source = op.responses(pages(spark, [("http://a/", PAGE.decode()), ("http://b/", "plain"), ("http://c/", "")]))
    every = source.union(op.derive(source))
    rows = [r.asDict() for r in every.collect()]
    members = {r.record_id: bytes(r.member) for r in op.gzipped(every).collect()}
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members[r["record_id"]] for r in rows))
    back = op.read(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    key = lambda r: r["record_id"]
    assert sorted((r.asDict() for r in back), key=key) == sorted(rows, key=key)
    cut = (tmp_path / "x.warc.gz").read_bytes()
    plain = __import__("gzip").decompress(cut)
    assert len(list(op.parse(plain[:-40]))) == len(rows) - 1


def test_other_charsets_and_heads():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nX: y\r\n\r\n<p>\xe9</p>"
    source = {"record_id": "<r>", "target_uri": "u", "warc_date": "d", "payload_digest": None, "block_digest": None, "block": block}
    meta, text = op.derivatives(source)
    assert text["block"].decode() == "é" and text["headers"]["WARC-Source-X"] == "y"
    assert text["headers"]["WARC-Source-WARC-Payload-Digest"] == sha1(b"<p>\xe9</p>") and text["payload_digest"] == sha1("é".encode())
    assert op.decoded(b"a", "text/html; charset=nonsense") == "a"
    assert op.split_message(b"no head")[2] == b"no head"


def test_odd_inputs(spark):
    odd = op.responses(pages(spark, [(None, None), ("http://a/", None), ("http://a/", ""), ("http://b/", "<p>" * 50_000), ("http://b/", "<" * 1000)]))
    got = op.derive(odd).collect()
    assert len(got) == 10 and all(r.record_id for r in got)
    assert op.derive(odd.limit(0)).count() == 0
    assert op.derive(op.derive(odd)).count() == 0


def test_headers_are_kept_and_encodings_undone():
    packed = __import__("gzip").compress(b"<p>h\xc3\xa9llo</p>")
    body = b"5\r\n" + packed[:5] + b"\r\n%x;x=1\r\n" % len(packed[5:]) + packed[5:] + b"\r\n0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Protocol: h2\r\nWARC-Protocol: tls\r\n"
    source = next(op.parse(record + b"Content-Length: %d\r\n\r\n" % len(head + body) + head + body + b"\r\n\r\n"))
    meta, text = op.derivatives(source)
    assert text["block"].decode() == "h\u00e9llo"
    assert text["headers"]["WARC-Source-Set-Cookie"] == "a\nb" and text["headers"]["WARC-Source-WARC-Protocol"] == "h2\ntls"
    for line in (b"header-Set-Cookie: a\r\nheader-Set-Cookie: b\r\n", b"warc-WARC-Protocol: h2\r\nwarc-WARC-Protocol: tls\r\n"):
        assert line in meta["block"]
    assert next(op.parse(__import__("gzip").decompress(op.serialise(text))))["headers"] == text["headers"]
    stuck = op.derivatives(source | {"block": b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n\x01\x02"})
    assert b"not-decoded: br" in next(stuck)["block"] and next(stuck)["block"] == b""


def test_cut_and_damaged_files_give_their_whole_records(monkeypatch):
    rows = [{"warc_type": "resource", "record_id": f"<{i}>", "block": random.Random(i).randbytes(3000)} for i in range(5)]
    none = dict.fromkeys(["refers_to", "target_uri", "warc_date", "payload_digest", "block_digest", "content_type", "headers"])
    members = [op.serialise(none | row) for row in rows]
    whole = b"".join(members)
    for chunk in (op.CHUNK, 64):
        monkeypatch.setattr(op, "CHUNK", chunk)
        for content in (whole, gzip.decompress(whole)):
            assert [(r["record_id"], r["block"]) for r in op.parse(content)] == [(r["record_id"], r["block"]) for r in rows]
        cut = whole[: len(whole) - len(members[-1]) // 2]
        assert [r["record_id"] for r in op.parse(cut)] == [f"<{i}>" for i in range(4)]
        bad = whole[: len(whole) - len(members[-1])] + b"\x1f\x8bnonsense"
        assert [r["record_id"] for r in op.parse(bad)] == [f"<{i}>" for i in range(5)][:4]
    assert list(op.parse(b"")) == [] and list(op.parse(b"WARC/1.1\r\nContent-Length: many\r\n\r\n"))[0]["block"] == b""


@pytest.mark.parametrize("unit", ["<a ", "<title>", "<", "<a href=\"", "<!--", "<script>", "</script ", "<a href='x' ", "&amp", " \n ", "<p", "<title></title"])
def test_a_hostile_megabyte_takes_linear_time(unit):
    page = unit * ((1 << 20) // len(unit))
    began = time.process_time()
    op.read_page(page)
    assert time.process_time() - began < 20


DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote|pre|title|head|body|nav|td|th)\b[^>]*>", re.I)


def slow_text(page):
    """The text of a page by one substitution after another."""
    body = re.sub(r"<[a-zA-Z/!?][^>]*>", "", BREAK.sub("\n", DROPPED.sub(" ", page)))
    return re.sub(r"\s*\n\s*", "\n", re.sub(r"[^\S\n]+", " ", html.unescape(body))).strip()


def test_pages_equal_a_slow_converter(spark, sf_dir):
    rng = random.Random(3)
    parts = ["<p>", "</p>", "<br/>", "a b", " & ", "&lt;x&gt;", "<!-- c -->", "<script>if (a<b) x</script>", "<STYLE >p</style >", "<a href='u'>", "</a>",
             "<H1 class=x>", "</h1>", "\n", "\t ", "1 < 2", "<b>", "</b>", "<title>T &amp; t</title>", "<?php ?>", "é", "<!doctype html>"]
    made = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(600)]
    made += [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r.html]
    for page in made:
        assert op.plain_text(page) == slow_text(page)


def test_links_and_titles():
    page = "<TITLE x> A\n B </title><a class=k HREF = \"/a>b\">1</a><A href='c'>2</a><a href=d>3</a><a name=x>4</a><link href=no><title>second</title>"
    text, title, links = op.read_page(page)
    assert title == "A\nB" and links == ["/a>b", "c", "d"] and text.endswith("second")
