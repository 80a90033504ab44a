"""URL verdicts that follow redirects: rules on addresses, carried to their aliases.

Aliases are the addresses that redirects and canonical links connect: a page's address and its
normal form (what servers redirect to: no www or m host, no fragment, tracking parameters,
index page or closing slash), the targets of its canonical links, and of its refresh. A page
without a rule of its own is blocked if an address of its component is blocked by a rule
and none is explicitly allowed. Built-in expressions, joins and aggregates only.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.components import connected_components
from memlake.session import durable

HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` (allow or block) for a host with all its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = [
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]


def host_of(url: Column) -> Column:
    """The host with A-Z, and no other letters, lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATH, 2)


def longest_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; of equally long ones the first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def normal_form(url: Column) -> Column:
    """The address servers redirect to; null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), QUERY, 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)(utm_[a-z]+|ref)=[^&]*", ""), "^&", "")
    whole = F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole)


def _without_dots(path: Column) -> Column:
    """``path`` (from its first slash on) with the segments ``.`` and ``..`` carried out."""

    def add(done: Column, segment: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment == "..", shorter).when(segment == ".", done).otherwise(F.concat(done, F.array(segment)))

    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), add)
    # A path that ends in a dot segment names a folder.
    folder = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def _target(url: Column, link: Column) -> Column:
    """``link`` on the page ``url`` as a whole address; null if there is none or it is no address (``mailto:``)."""
    scheme = F.concat(F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.lit(":"))
    site = F.concat(scheme, F.lit("//"), host_of(url))
    own, folder = path_of(url), F.regexp_extract(path_of(url), r"(?s)^(.*/)[^/]*$", 1)
    path, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)[?#].*$", 0)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(site, _without_dots(path), rest))
        .when(link.startswith("?"), F.concat(site, own, link))
        .when(link.startswith("#"), F.concat(site, own, query, link))
        .otherwise(F.concat(site, _without_dots(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)), rest))
    )


def _decoded(tag: Column) -> Column:
    """``tag`` with ``&`` for its written forms: an address of several parameters holds them."""
    return F.regexp_replace(tag, r"&(?:[aA][mM][pP]|#0*38|#[xX]0*26);", "&")


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) of addresses: page to normal form, and page to normal targets with these to their normal form."""
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    canonical = F.transform(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(_decoded(tag), HREF, 1))
    refresh = F.regexp_extract(_decoded(F.regexp_extract(html, REFRESH, 0)), REFRESH_URL, 1)
    links = F.array_distinct(F.concat(canonical, F.array(refresh)))
    found = pages.where(url.contains("://")).select(url.alias("a"), F.array(normal_form(url)).alias("own"), links.alias("links"))
    found = found.select("a", F.concat("own", F.transform("links", lambda link: _target(F.col("a"), link))).alias("targets"))
    edges = found.select("a", F.explode("targets").alias("b")).where(F.col("b").isNotNull())
    targets = edges.select(F.col("b").alias("a"), normal_form(F.col("b")).alias("b")).where(F.col("b").isNotNull())
    return edges.unionByName(targets).where(F.col("a") != F.col("b")).distinct()


def blocked_aliases(edges: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """(url) of the addresses in components that hold a blocked and no allowed address."""
    placed = connected_components(edges)
    node = F.col("node")
    judged = placed.withColumn("verdict", longest_rule(host_of(node), path_of(node), rules)["verdict"])
    judged = durable(judged, "judged-addresses")
    flags = judged.groupBy("component").agg(
        F.max(F.col("verdict") == "block").alias("blocked"), F.max(F.col("verdict") == "allow").alias("allowed")
    )
    chosen = flags.where(F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).select("component")
    return judged.join(durable(chosen, "blocked-components"), "component", "left_semi").select(node.alias("url"))


def judge_urls(pages: DataFrame, rules: list[UrlRule] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by (rule, alias or default) for every row.

    ``edges`` are more (a, b) of addresses that redirect to each other, from a crawl's log. A null address or one
    without ``://`` has no host, rule or aliases and is allowed. Null pages have no links. Rows
    stand for themselves, repeated ones too; other columns are ignored.
    """
    url = F.col("url").cast("string")
    known = alias_edges(pages)
    if edges is not None:
        known = known.unionByName(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")))
    blocked = durable(blocked_aliases(known, rules), "blocked-addresses").withColumn("by_alias", F.lit(True))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    joined = rows.join(blocked, "url", "left")
    alias = F.coalesce("by_alias", F.lit(False))
    return joined.select(
        "page_id",
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(alias, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("own").isNotNull(), F.lit("rule")).when(alias, F.lit("alias")).otherwise(F.lit("default")).alias("decided_by"),
    )
