"""Markup read forwards: the same as by patterns, and no slower on hostile pages; windows that are limited before they are dealt."""

from __future__ import annotations

import gzip
import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliant.llm import near_dedup, substring_dedup, warc

BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|title|blockquote|pre|hr)\b[^>]*>", re.I)
HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>", re.I | re.S)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
LINK = re.compile(r"<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = ["<p>", "</p>", "<", ">", "<a ", "<A\n", "href=", "href =", '"', "'", "x", " ", "&amp;", "<!--", "-->", "--", "<script>", "<Script x", "</script >", "</SCRIPT", "<style", "</style>", "<title", "<title>", "</title>", "<html ", 'lang="de"', "lang=en", "<b>", "\n", "/u?q=1", "<template>", "</template>", "<noscript", "<alt", "-"]


def test_equals_patterns_on_random_markup():
    rng = random.Random(9)
    for _ in range(4000):
        page = "".join(rng.choices(PARTS, k=rng.randint(0, 25)))
        shown = HIDDEN.sub(" ", page)
        assert warc.without_hidden(page) == shown, page
        assert warc.without_tags(shown) == re.sub(r"<[^>]*>", "", BREAK.sub("\n", shown)), page
        title, lang = TITLE.search(page), LANG.search(page)
        assert warc.title_of(page) == (" ".join(html.unescape(title[1]).split()) if title else ""), page
        assert warc.language_of(page) == (lang[1].lower() if lang else ""), page
        assert warc.links_of(shown) == [html.unescape(a or b or c) for a, b, c in LINK.findall(shown)], page


@pytest.mark.parametrize("part", ["<script>", "<title>", "<title", "<!--", "<", "<a ", "<a href=", '<a href="', "<html ", "<html lang", "</script", "<p", "<style></script>", "href=", "<!--<script>", "&"])
def test_hostile_pages_take_no_longer(part):
    page = part * ((1 << 20) // len(part))
    began = time.perf_counter()
    rows = warc.derived(1, "<urn:x>", "http://a/", "d", b"HTTP/1.1 200 OK\r\n\r\n" + page.encode())
    assert [r[1] for r in rows] == ["metadata", "conversion"] and time.perf_counter() - began < 8


def test_bodies_that_grow_without_end(monkeypatch):
    monkeypatch.setattr(warc, "MOST_INFLATED", 1000)
    monkeypatch.setattr(warc.inflated, "__defaults__", (1000,))
    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n"
    meta, text = warc.derived(1, None, None, None, head + gzip.compress(b"x" * 100_000))
    assert "source-undecoded: gzip of over 1000 bytes" in meta[-1] and text[-1] == ""
    assert warc.derived(1, None, None, None, head + gzip.compress(b"ab") + gzip.compress(b"c"))[1][-1] == "abc"


def test_long_runs_of_marks_are_cut_in_one_pass(spark):
    texts = ["." * 200_000, "a... b.... c!?x d. e", "..!" * 50_000 + " end", "x.\n\n. y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.perf_counter()
    got = [r[0] for r in df.select(substring_dedup.sentences(F.col("t"))).collect()]
    assert time.perf_counter() - began < 20
    plain = lambda t: [p for p in re.sub(r"([.!?]+[ \t\r\n\f\x0b]+|[。！？]+|\n[ \t\r\n\f\x0b]*)", "\\1\x01", t).split("\x01") if p]
    assert got[1] == plain(texts[1]) and got[3] == plain(texts[3]) and ["".join(p) for p in got] == texts


def test_no_task_orders_a_hot_bucket(spark):
    members = spark.createDataFrame([], "key long, node long, comp long, main long")
    sizes = spark.createDataFrame([], "node long, size long")
    plan = near_dedup.round_leaders(members, sizes)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
