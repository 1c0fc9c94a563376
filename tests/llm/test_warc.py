import gzip
import json
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import warc

PAGE = '<html><head><title> A &amp; B </title><style>p{}</style></head><body><!-- no --><p>One <b>bold</b>&nbsp;word<br>two</p><a href="/x?a=1&amp;b=2">L</a><script>var t="</p>"</script></body>'


def test_plain_text():
    assert warc.plain_text(PAGE) == "A & B\nOne bold word\ntwo\nL"
    assert warc.plain_text("") == "" and warc.plain_text("a < b") == "a < b"


def test_derivatives(spark, tmp_path):
    rows = [(1, "http://a/é", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "text only")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS record")
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 2 * len(rows)
    for key, url, page in rows:
        headers, block = warc.parse(warc.response(key, url, page, "1970-01-01T00:00:00Z"))[0]
        payload = (page or "").encode()
        assert block.endswith(b"\r\n\r\n" + payload) and headers["WARC-Payload-Digest"] == warc.digest(payload)
        own = [r for r in made if r.page_id == key]
        assert {r.record_type for r in own} == {"metadata", "conversion"}
        for r in own:
            h, b = warc.parse(r.record.encode())[0]
            assert r.refers_to == headers["WARC-Record-ID"] == h["WARC-Refers-To"] and r.target_uri == url and r.source_digest == warc.digest(payload)
            assert h["WARC-Block-Digest"] == r.block_digest == warc.digest(b) and r.content_length == len(b)
            if r.record_type == "conversion":
                assert b.decode() == warc.plain_text(page or "")
    warc.write_files(spark.createDataFrame(made), str(tmp_path / "w"))
    back = warc.read_files(str(tmp_path / "w"), spark).collect()
    assert sorted(r.headers["WARC-Record-ID"] for r in back) == sorted(r.record_id for r in made)
    assert warc.derivatives(warc.responses(pages.where("false"))).collect() == []


PIECES = [  # HTML, and what it leaves in the text
    ("one &lt;two&gt; ", "one <two> "),
    ("<p>", "\n"),
    ("</DIV >", "\n"),
    ("<b class='x'>bold</b>", "bold"),
    ("<!-- <p> hidden -->", ""),
    ("<script>if (a < b) { '<p>' }</SCRIPT >", ""),
    ("<style media=x>p > a {}</style>", ""),
    ("<custom-tag>", ""),
    ("<br/>", "\n"),
    ("3 < 4 ", "3 < 4 "),
    ("é ü\n", "é ü\n"),
    ("<!doctype html>", ""),
]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_text_by_construction(pieces):
    lines = (" ".join(x.split()) for x in "".join(t for _, t in pieces).split("\n"))
    assert warc.plain_text("".join(h for h, _ in pieces)) == "\n".join(x for x in lines if x)


def test_bad_pages_take_linear_time():
    for x in ("<a ", "<p", "<title>", "<script ", "<!--", "<a href=", "<script>", "<a href  ", "<title", "</", "&"):
        start = time.process_time()
        warc.scan(x * (2_000_000 // len(x)))
        warc.scan(x * (2_000_000 // len(x)) + ">")
        assert time.process_time() - start < 15


SOURCE = (
    b"noise\r\n\r\nWARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:a>\r\nno colon here\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nX-Twice: 1\r\nX-Twice: 2\r\n"
    b"X-Long: a\r\n  b\r\nWARC-Target-URI: http://a/\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID:<urn:b>\r\nContent-Length: oops\r\n\r\nHTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>gone"
)


def test_records_by_hand():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("<title>T</title><a href=u>café</a>".encode("latin-1"))
    (one, meta, text), (two, meta2, text2) = warc.derive(SOURCE % (len(block), block))
    h, b = warc.parse(text)[0]
    assert b.decode() == "T\ncafé" and h["WARC-Refers-To"] == "<urn:a>" and h["WARC-Date"] == "2020-01-02T03:04:05Z" and h["WARC-Source-Payload-Digest"] == "sha1:X"
    h, b = warc.parse(meta)[0]
    about = json.loads(b)
    assert about["source"]["X-Twice"] == ["1", "2"] and about["source"]["X-Long"] == "a b" and about["title"] == "T" and about["links"] == ["u"]
    assert (h["WARC-Type"], h["WARC-Target-URI"]) == ("metadata", "http://a/")
    assert warc.parse(text2)[0][1] == b"gone" and warc.parse(text2)[0][0]["WARC-Refers-To"] == "<urn:b>" and json.loads(warc.parse(meta2)[0][1])["status"] == "HTTP/1.1 404 Not Found"


def test_bodies():
    chunked = [("transfer-encoding", "chunked")]
    assert warc.page_text(chunked, b"4\r\nabcd\r\n3;x\r\nefg\r\n0\r\n\r\n") == "abcdefg"
    assert warc.page_text([("Content-Encoding", "gzip")], b"not gzip") == "not gzip"
    assert warc.page_text([], b"<meta charset='cp1252'>\x80") == "<meta charset='cp1252'>€"
    assert warc.page_text([("Content-Type", "text/html; charset=nonsense")], b"a\xff") == "a�"


def test_several_records_in_a_row(spark):
    rows = [(7, warc.response(1, "u", "<p>a", warc.EPOCH) + b"\r\n\r\n" + warc.response(2, "v", "<p>b", warc.EPOCH)), (8, None), (9, b"junk")]
    got = warc.derivatives(spark.createDataFrame(rows, "page_id long, record binary")).collect()
    assert sorted((r.page_id, r.target_uri, r.record_type) for r in got) == [(7, u, t) for u in "uv" for t in ("conversion", "metadata")]
