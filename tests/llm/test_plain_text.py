"""Text of pages in upper case, and all references to characters."""

import html
from html.entities import html5

from pyspark.sql import functions as F

from memlake.llm.warc import derivatives, plain_text, responses

UPPER = "<HTML><HEAD><TITLE>t</TITLE></HEAD><BODY><SCRIPT>var a = 1;</SCRIPT><Style>p{}</sTYLE><NOSCRIPT>no</NOSCRIPT><P>one</P><P>two<BR>three</P></BODY></HTML>"


def texts(spark, pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r[0] for r in rows.orderBy("i").select(plain_text(F.col("html"))).collect()]


def test_upper_case_pages(spark):
    assert texts(spark, [UPPER, UPPER.lower()]) == ["one\ntwo\nthree"] * 2


def test_references(spark):
    pages = ["it&#8217;s &#x27;x&#X27; &mdash; caf&eacute; &#128512; &#x1F600;", "&amp;lt; &#38;lt; &AMP;copy; &amp;#65; a&b &unknown; &#; &amp x & &eacute", "&#0;&#xD800;&#99999999999;&#x110000;|&#150;&#129;|&#10;a&#160;b", "&NotEqualTilde; &#00065;", "&eacute;", None]
    found = texts(spark, pages)
    assert found[0] == "it’s 'x' — café 😀 😀"
    assert found[1] == "&lt; &lt; &copy; &#65; a&b &unknown; &#; &amp x & &eacute"
    assert found[2] == "�" * 4 + "|–\x81| a b"
    assert found[3:] == ["≂̸ A", "é", None]


def test_all_names(spark):
    names = [n for n in html5 if n.endswith(";") and n not in ("nbsp;", "NonBreakingSpace;", "Tab;", "NewLine;")]
    found = texts(spark, [f"x&{n}x" for n in names])
    assert found == [html.unescape(f"x&{n}x") for n in names]


def test_conversion_record(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "<P>a&mdash;b</P><SCRIPT>x()</SCRIPT>")], "page_id long, url string, html string")
    found = {r["warc_type"]: r for r in derivatives(responses(pages, "2024-01-01T00:00:00Z")).collect()}
    assert (found["conversion"]["block"], found["conversion"]["content_length"]) == ("a—b", 5)


def test_time_grows_with_the_length_alone(spark):
    """Pages of 2 MB that open something again and again and never close it."""
    import time

    openings = ["<!-- x ", "<script> x ", "<style x ", "<head> x ", "<noscript> x ", "<p x ", "</head x ", "<head><!-- --></head ", "&#", "<"]
    pages = [opening * (2_000_000 // len(opening)) for opening in openings]
    texts(spark, ["warm"])
    start = time.perf_counter()
    found = texts(spark, pages)
    assert time.perf_counter() - start < 2 * len(pages)
    assert found[:3] == ["", "", ""] and found[3].startswith("x x")
