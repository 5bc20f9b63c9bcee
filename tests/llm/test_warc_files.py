"""WARC files as crawlers write them: versions, nested marks, codings, source headers, other record types, short records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from foliant.llm import warc

PAGE = b"<p>one</p><p>two</p>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Own: kept\r\n"


def record(n: int, block: bytes, kind: str = "response", version: str = "1.1", more: str = "") -> bytes:
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <r{n}>\r\nWARC-Date: d\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_real_files(spark, tmp_path, packed):
    nested = record(99, b"x", version="1.0")
    zipped = gzip.compress(PAGE)
    chunks = b"5\r\n" + zipped[:5] + b"\r\n%x\r\n" % (len(zipped) - 5) + zipped[5:] + b"\r\n0\r\n\r\n"
    records = [
        record(1, HTTP + b"\r\n" + PAGE, more="WARC-Payload-Digest: sha1:OWN\r\nWARC-Block-Digest: sha1:BLOCK\r\n"),
        record(2, b"GET / HTTP/1.1\r\n\r\n", kind="request"),
        record(3, HTTP + b"\r\n" + b"<p>a</p>" + nested + b"WARC/1.1\r\nend", version="1.0"),
        record(4, HTTP + b"Transfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks),
        record(5, HTTP + b"Content-Encoding: br\r\n\r\n\x01\x02"),
        record(6, b"whole", more="Note: says WARC/1.0\r\n"),
        record(7, b"cut short")[:-8],
    ]
    raw = b"".join(map(gzip.compress, records)) if packed else b"".join(records)
    (tmp_path / ("f.warc.gz" if packed else "f.warc")).write_bytes(raw)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)  # so that a plain file is read in several splits
    try:
        read = warc.read_warc(spark, str(tmp_path)).collect()
        got = {(r["refers_to"], r["record_type"]): r for r in warc.derive(warc.read_warc(spark, str(tmp_path))).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["record_id"], r["complete"]) for r in read] == [(f"<r{i}>", i < 7) for i in range(1, 8)]
    assert {k[0] for k in got} == {f"<r{i}>" for i in (1, 3, 4, 5, 6)} and len(got) == 10
    meta = got["<r1>", "metadata"]
    assert meta["payload_digest"] == "sha1:OWN" and "source-record-warc-block-digest: sha1:BLOCK\r\n" in meta["block"] and "source-http-x-own: kept\r\n" in meta["block"]
    assert bytes(read[2]["block"]).endswith(nested + b"WARC/1.1\r\nend")
    assert got["<r1>", "conversion"]["block"] == got["<r4>", "conversion"]["block"] == "one\ntwo"
    assert got["<r5>", "conversion"]["block"] == "" and "source-undecoded: br\r\n" in got["<r5>", "metadata"]["block"]


def test_odd_records(spark, tmp_path):
    odd = {"idna": b"xn--\xff" * 3, "utf-7": b"a +2AA- b", "hex": b"zz", "undefined": b"x", "utf-16": b"\xd8", "nonsense": b"n"}
    rows = [(i, None if i == 1 else f"<r{i}>", HTTP.replace(b"text/html", f"text/html; charset={name}".encode()) + b"\r\n" + body) for i, (name, body) in enumerate(odd.items())]
    df = spark.createDataFrame([(i, r, None, None, b) for i, r, b in rows] + [(9, None, None, None, None)], "page_id long, record_id string, target_uri string, date string, block binary")
    got = warc.derive(df.withColumn("headers", F.lit(None).cast("string"))).collect()
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert len(by) == 14 and by[1, "conversion"]["refers_to"] is None and by[1, "conversion"]["record_id"] != by[9, "conversion"]["record_id"]
    assert by[1, "conversion"]["block"] == "a ? b" and by[5, "conversion"]["block"] == "n" and by[9, "conversion"]["block"] == ""
    written = [bytes(r[0]) for r in warc.derive(df).select(warc.to_warc()).collect()]
    assert len(written) == 14 and sum(b"WARC-Refers-To" in w for w in written) == 10
    (tmp_path / "bad.warc").write_bytes(record(1, b"a").replace(b"Content-Length: 1", b"Content-Length: abc") + record(2, b"b"))
    assert [(r["record_id"], r["complete"]) for r in warc.read_warc(spark, str(tmp_path / "bad.warc")).collect()] == [("<r1>", False), ("<r2>", True)]
    kinds = warc.responses(spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string")).withColumn("record_type", F.lit("warcinfo"))
    assert warc.derive(kinds).count() == 0


class Reader(HTMLParser):
    """A restatement of the text, title and links of a page by a parser, where the operator uses patterns."""

    BLOCKS = {"p", "div", "br", "li", "ul", "ol", "h1", "tr", "table", "title", "pre", "hr", "section"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.title, self.hidden, self.in_title, self.lang = [], [], [], 0, False, ""

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self.hidden += tag in ("script", "style", "template")
        self.out += [" "] * (tag in ("script", "style", "template"))  # what is hidden parts words
        self.in_title |= tag == "title"
        self.out += ["\n"] * (tag in self.BLOCKS)
        if tag == "html":
            self.lang = (own.get("lang") or "").lower()
        if tag == "a" and "href" in own and not self.hidden:
            self.links.append(own["href"])

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template")
        self.in_title &= tag != "title"
        self.out += ["\n"] * (tag in self.BLOCKS)

    def handle_comment(self, data):
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
            self.title += [data] * self.in_title


def test_derivatives_equal_a_parser(spark):
    rnd = random.Random(17)
    words = ["one", "zwei", "Dr&eacute;i", "&amp;", "4 &lt; 5", "漢字", "x\ty", "  "]

    def body(depth: int) -> str:
        kind = rnd.randrange(9)
        if depth > 3 or kind < 3:
            return " ".join(rnd.choices(words, k=rnd.randrange(4)))
        if kind == 3:
            return f"<a class=c href='/p{rnd.randrange(99)}?a=1&amp;b=2'>{body(depth + 1)}</a>"
        if kind == 4:
            return rnd.choice(("<script>var a = '<p>no</p>';</script>", "<style>p { }</style>", "<!-- <a href='/no'>no</a> -->", "<br>", "<hr/>"))
        tag = rnd.choice(("p", "div", "li", "h1", "pre", "b", "span", "section"))
        return f"<{tag}>" + "".join(body(depth + 1) for _ in range(rnd.randrange(5))) + f"</{tag}>"

    pages = {i: f"<html lang='{rnd.choice(('de', 'EN'))}'><head><title>{rnd.choice(words)} t{i}</title></head>" + "".join(body(0) for _ in range(12)) + "</html>" for i in range(60)}
    df = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in pages.items()], "page_id long, url string, html string")
    sources = {r["page_id"]: r for r in warc.responses(df).collect()}
    sha1 = lambda raw: "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
    got = {(r["page_id"], r["record_type"]): r for r in warc.derive(warc.responses(df)).collect()}
    assert len(got) == 120
    for i, page in pages.items():
        reader = Reader()
        reader.feed(page)
        plain, meta = got[i, "conversion"], got[i, "metadata"]
        assert plain["block"] == "\n".join(line for x in "".join(reader.out).split("\n") if (line := " ".join(x.split())))
        for r in (plain, meta):
            assert (r["refers_to"], r["target_uri"], r["date"]) == (sources[i]["record_id"], f"http://h/{i}", sources[i]["date"])
            assert r["payload_digest"] == sha1(page.encode()) and r["block_digest"] == sha1(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        lines = [x.partition(": ")[::2] for x in meta["block"].split("\r\n") if x]
        assert [v for k, v in lines if k == "outlink"] == reader.links
        facts = dict(x for x in lines if x[0] != "outlink")
        assert facts["title"] == " ".join("".join(reader.title).split()) and facts["languages"] == reader.lang and facts["text-length"] == str(len(plain["block"]))
        assert facts["source-http-content-type"] == "text/html; charset=utf-8" and facts["source-http-content-length"] == str(len(page.encode())) and facts["source-status"] == "HTTP/1.1 200 OK"
    assert {r["record_id"] for r in got.values()} == {r["record_id"] for r in warc.derive(warc.responses(df.repartition(3))).collect()} and len({r["record_id"] for r in got.values()}) == 120
