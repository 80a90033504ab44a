"""Links of pages as whole addresses, and hosts in lower case."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from memlake.llm.url_filter import _target, host_of, judge_urls

PAGE = "http://a.net/x/y/page.html?q=1"
LINKS = ["z.html", "../z", "./z?id=3", "../../../z", "..", ".", "../", "?id=3", "/go?u=http://a.com/de/1", "/a/../b/./c", "/x/..", "z?u=http://a.com/de/1"]
LINKS += ["//b.net/q", "https://b.net/../q", "a/b/../c#top", "#top", "/", "x/.hidden/..a"]


def test_links_as_the_standard_library(spark):
    for page in (PAGE, "http://a.net/", "http://a.net/one"):
        rows = spark.createDataFrame([(page, link) for link in LINKS], "url string, link string")
        found = {r["link"]: r["t"] for r in rows.select("link", _target(F.col("url"), F.col("link")).alias("t")).collect()}
        want = {link: urljoin(page, link) for link in LINKS} | {"https://b.net/../q": "https://b.net/../q"}
        assert found == want
    rows = spark.createDataFrame([("http://a.net", x) for x in ("z", "mailto:x@y.z", "", "javascript:go('http://b.net')")], "url string, link string")
    assert [r[0] for r in rows.select(_target(F.col("url"), F.col("link"))).collect()] == ["http://a.net/z", None, None, None]


@pytest.mark.parametrize(
    "alias, page, html",
    [
        ("http://x.com/de/1", "http://x.com/en/p", "<link rel=canonical href='../de/1'>"),
        ("http://x.com/de/1", "http://x.com/de2/p", '<meta http-equiv=refresh content="0; url=../de/1">'),
        ("http://x.com/de/1?a=1&b=2", "http://y.net/p", '<link rel="canonical" href="http://x.com/de/1?a=1&amp;b=2">'),
        ("http://x.com/de/1", "http://y.net/p", '<link rel=canonical href="http://z.net/"><LINK REL=canonical href="http://x.com/de/1">'),
    ],
)
def test_block_is_carried(spark, alias, page, html):
    pages = spark.createDataFrame([(1, page, html), (2, "http://else.net/q", "")], "page_id long, url string, html string")
    found = {r["page_id"]: (r["verdict"], r["decided_by"]) for r in judge_urls(pages).collect()}
    assert found == {1: ("block", "alias"), 2: ("allow", "default")}


def test_alias_with_two_parameters_and_own_query(spark):
    rows = [(1, "http://y.net/p?a=1&b=2", ""), (2, "http://y.net/q", '<link rel=canonical href="/p?a=1&#38;b=2"><link rel=canonical href="http://x.com/de/1">')]
    rows += [(3, "http://w.net/l", ""), (4, "http://w.net/l?id=3", '<link rel=canonical href="http://x.com/de/2">'), (5, "http://w.net/l?id=4", '<link rel=canonical href="?id=3">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in judge_urls(pages).collect()} == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "block"}


def test_address_in_a_parameter_is_no_alias(spark):
    pages = spark.createDataFrame([(1, "http://y.net/p", '<link rel=canonical href="/go?u=http://a.com/de/1">')], "page_id long, url string, html string")
    assert [(r["verdict"], r["decided_by"]) for r in judge_urls(pages).collect()] == [("allow", "default")]


def test_only_ascii_letters_of_a_host_change(spark):
    rows = spark.createDataFrame([("http://BÜCHER.Example/É",), ("http://\u212aA",)], "url string")
    assert [r[0] for r in rows.select(host_of(F.col("url"))).collect()] == ["bÜcher.example", "\u212aa"]
