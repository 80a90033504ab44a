"""WARC derivatives: a metadata and a plain-text conversion record for every response.

Responses are rows: target_uri, warc_date, status_line, headers (array of name, value) and html.
Both derived records refer to the response's record id and name its target, date and digests; the
metadata record keeps the source headers and what links the records, the conversion record the
plain text of the page. Everything is a column expression over one row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WARC_VERSION = "WARC/1.1"
CRLF = "\r\n"

# What HTML often writes for characters; ``&amp;`` comes after all others.
ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
]
AMP = "&amp;"
# All others: a reference is decoded where it ends with a semicolon.
REFERENCE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
RARE = r"&(?!amp;)(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# Blanks and line breaks of the source are blanks of the text.
NAMED = {name[:-1]: char for name, char in html5.items() if name.endswith(";")} | {"nbsp": " ", "NonBreakingSpace": " ", "Tab": " ", "NewLine": " "}
# Numbers from 128 to 159 mean the characters of Windows-1252, where it has one.
WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(128, 160)}

# Comments, scripts and styles (to the end of the page where they are not closed, as in a browser) and control characters.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|[\x00-\x1F]+"
# Elements that are never shown, where they are closed.
HIDDEN = ("head", "noscript")
BLOCK_TAG = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title|blockquote|pre)\b[^>]*>"
ANY_TAG = r"<[a-zA-Z/!?][^>]*>"


def _table(pairs: dict) -> Column:
    """A constant map, written as one text."""
    return F.str_to_map(F.lit("\x02".join(f"{name}\x01{char}" for name, char in pairs.items())), F.lit("\x02"), F.lit("\x01"))


def _numbered(name: Column) -> Column:
    """The character of ``#8217`` or ``#x2019``; numbers that are no character give U+FFFD."""
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    digits = F.regexp_replace(F.when(hexadecimal, F.substr(name, F.lit(3))).otherwise(F.substr(name, F.lit(2))), "^0+(?=.)", "")
    number = F.when(F.length(digits) <= 8, F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("long"))
    refused = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    # As UTF-8: two, three or four bytes from 128 on.
    tail = lambda shift: F.shiftright(number, shift).bitwiseAND(0x3F) + 0x80
    lead = lambda shift, mark: F.shiftright(number, shift) + mark
    octets = lambda *parts: F.concat(*[F.lpad(F.hex(x), 2, "0") for x in parts])
    code = (
        F.when(number < 0x80, octets(number))
        .when(number < 0x800, octets(lead(6, 0xC0), tail(0)))
        .when(number < 0x10000, octets(lead(12, 0xE0), tail(6), tail(0)))
        .otherwise(octets(lead(18, 0xF0), tail(12), tail(6), tail(0)))
    )
    windows = F.nullif(F.element_at(_table(WINDOWS), number.cast("string")), F.lit(""))
    char = F.coalesce(F.when(number.between(128, 159), windows), F.decode(F.unhex(code), "UTF-8"))
    return F.when(refused, F.lit("\ufffd")).when((number < 0x20) | (number == 0xA0), F.lit(" ")).otherwise(char)


def decoded(text: Column) -> Column:
    """``text`` with every reference to a character decoded once; unknown names stay."""
    for written, char in ENTITIES:
        text = F.replace(text, F.lit(written), F.lit(char))

    def part(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        char = F.when(name.startswith("#"), _numbered(name)).when(name != "", F.element_at(_table(NAMED), name))
        return F.when(char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, F.substr(piece, F.length(name) + 2)))

    pieces = F.split(text, "&", -1)
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), part)
    whole = F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))
    return F.when(text.rlike(RARE), whole).otherwise(F.replace(text, F.lit(AMP), F.lit("&")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times, computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _without(text: Column, element: str) -> Column:
    """``text`` without an element, from each opening tag to the next closing one. Every piece between
    closing tags is looked through once, so the time grows with the length alone."""

    def cut(piece: Column) -> Column:
        opened = piece.rlike(rf"(?i)<{element}\b")
        return F.when(opened, F.regexp_replace(piece, rf"(?is)<{element}\b.*", " ")).otherwise(F.concat(piece, F.lit(f"</{element}>")))

    def joined(pieces: Column) -> Column:
        closed = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), cut)
        return F.concat(F.array_join(closed, ""), F.element_at(pieces, -1))

    return _once(F.split(text, rf"(?i)</{element}\s*>", -1), joined)


def _without_tags(text: Column) -> Column:
    """Tags end at a ``>``: behind the last one none is looked for."""
    tagged = F.regexp_extract(text, "(?s)^.*>", 0)
    tail = F.substr(text, F.length(tagged) + 1)
    return F.concat(F.regexp_replace(F.regexp_replace(tagged, BLOCK_TAG, "\n"), ANY_TAG, ""), tail)


def plain_text(html: Column) -> Column:
    """The visible text: one line per block, runs of blanks as one, no empty lines; null for null.

    Linear in the length of the page: what a pattern begins to match it also ends.
    """
    text = F.regexp_replace(html, UNSEEN, " ")
    for element in HIDDEN:
        text = _without(text, element)
    text = _once(_once(text, _without_tags), decoded)
    # Runs of blanks first: looked for before every line break they would be gone through again and again.
    text = F.regexp_replace(text, "  +", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def record_id(*parts: Column) -> Column:
    """A name of the record's content, in the form of a UUID: the same for a repeated run."""
    key = F.md5(F.concat_ws("\x00", *parts))
    cut = [F.substring(key, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, warc_date: str) -> DataFrame:
    """``pages`` (page_id, url, html) as responses of a server that sent them as UTF-8 HTML."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit(warc_date).alias("warc_date"),
        F.lit("HTTP/1.1 200 OK").alias("status_line"),
        F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", size)).alias("headers"),
        F.col("html").cast("string").alias("html"),
    )


def derivatives(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Two rows, metadata and conversion, for every response.

    Columns: ``key``, warc_type, record_id, refers_to, target_uri, warc_date, content_type, block,
    content_length, block_digest, payload_digest, source_digest (of the response's payload) and
    source_headers. A null page counts as an empty one, a null target is left out of the header, null
    headers are none. Repeated responses give repeated records with equal ids; other columns are ignored.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    lines = F.transform(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.concat_ws(": ", h["name"], h["value"]))
    head = F.concat_ws(CRLF, F.col("status_line"), lines)
    source = found.select(
        F.col(key),
        "target_uri",
        "warc_date",
        head.alias("source_headers"),
        digest(html).alias("source_digest"),
        digest(F.concat(head, F.lit(CRLF + CRLF), html)).alias("source_block_digest"),
        plain_text(html).alias("text"),
    )
    key_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    ids = [key_text, F.coalesce("target_uri", F.lit("")), F.coalesce("warc_date", F.lit("")), F.col("source_block_digest")]
    named = source.select(
        "*",
        record_id(F.lit("response"), *ids).alias("refers_to"),
        record_id(F.lit("metadata"), *ids).alias("metadata_id"),
        record_id(F.lit("conversion"), *ids).alias("conversion_id"),
    )
    fields = F.concat(
        F.concat(F.lit("source-record: "), F.col("refers_to"), F.lit(CRLF)),
        F.concat(F.lit("source-block-digest: "), F.col("source_block_digest"), F.lit(CRLF)),
        F.concat(F.lit("source-payload-digest: "), F.col("source_digest"), F.lit(CRLF)),
        F.concat(F.lit("conversion-record: "), F.col("conversion_id"), F.lit(CRLF)),
        F.concat_ws("", F.transform(F.split("source_headers", CRLF), lambda line: F.concat(F.lit("source-header: "), line, F.lit(CRLF)))),
    )
    record = lambda kind, own, mime, block: F.struct(
        F.lit(kind).alias("warc_type"), own.alias("record_id"), F.lit(mime).alias("content_type"), block.alias("block")
    )
    both = F.array(
        record("metadata", F.col("metadata_id"), "application/warc-fields", fields),
        record("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text")),
    )
    rows = named.select(key, "target_uri", "warc_date", "refers_to", "source_digest", "source_headers", F.explode(both).alias("r"))
    digested = rows.select("*", digest(F.col("r.block")).alias("block_digest"))
    return digested.select(
        key,
        "r.warc_type",
        "r.record_id",
        "refers_to",
        "target_uri",
        "warc_date",
        "r.content_type",
        F.octet_length("r.block").cast("long").alias("content_length"),
        "block_digest",
        F.when(F.col("r.warc_type") == "conversion", F.col("block_digest")).alias("payload_digest"),
        "source_digest",
        "source_headers",
        F.col("r.block").alias("block"),
    )


def record_text(digests: bool = True) -> Column:
    """Header and block of a derived record as they stand in a WARC file, without the final blank lines."""
    lines = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri")]
    lines += [("WARC-Date", "warc_date"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    if digests:
        lines += [("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest")]
    named = [F.concat(F.lit(f"{name}: "), F.col(column).cast("string")) for name, column in lines]
    return F.concat(F.concat_ws(CRLF, F.lit(WARC_VERSION), *named), F.lit(CRLF + CRLF), F.col("block"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip", mode: str = "errorifexists") -> None:
    """Derived records as WARC files, one file per task."""
    writer = records.select(record_text().alias("value")).write.mode(mode)
    writer.option("compression", compression).option("lineSep", CRLF + CRLF).text(path)
