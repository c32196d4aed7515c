"""URL filters with redirect equivalence.

A rule is a host and a path, block or allow; it fits its host and all subdomains
where the path starts with the rule's, and the longest fitting rule decides. A
URL that no rule fits takes the decision of its aliases: URLs joined to it by
redirects (a table of them, or meta refresh in the page) and canonical links,
taken as undirected edges. Links are read by an HTML parser and resolved as a
browser does: every tag counts, comments and scripts don't, ``<base>`` does. Within a component an explicit allow goes before any
block; without a decision in the component the URL is allowed.

Components run over distinct URLs that have an edge, distributed, by
``connected_components``; no group is collected anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, cut

REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:"([^"]*)|'([^']*)|(\S.*))""", re.I | re.S)
SMALL_RULES = 256


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def plain_path(path: Column) -> Column:
    """A path without its dot segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    start = F.array().cast("array<string>")
    step = lambda seen, x: F.when(x == ".", seen).when(x == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0)))).otherwise(F.concat(seen, F.array(x)))
    kept = F.aggregate(parts, start, step)
    end = F.when(path.rlike(r"/\.\.?$"), F.when(F.size(kept) > 0, "/").otherwise("")).otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def url_key(url: Column) -> Column:
    """What stands for a URL in the graph: host, path and query, without scheme, fragment, default port and dot segments; null without a host."""
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    port = F.when(scheme == "https", r":(443)?$").otherwise(r":(80)?$")
    host = F.regexp_replace(host_of(url), port, F.lit(""))
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", "/").otherwise(plain_path(path_of(url))), query))


class Links(HTMLParser):
    """The canonical links and refreshes of a page, as they are written, and its base."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea")  # tags inside these are text

    def __init__(self) -> None:
        super().__init__()
        self.base: str | None = None
        self.found: list[str] = []

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """The end of a ``<![`` of any kind; browsers take it as a comment that ends with the next >."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """``<title/>`` opens a title all the same."""
        self.handle_starttag(tag, attrs)
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in reversed(attrs)}  # of a repeated attribute the first counts
        if tag == "base" and self.base is None and given.get("href", "").strip():
            self.base = given["href"].strip()
        elif tag == "link" and "canonical" in given.get("rel", "").lower().split() and given.get("href", "").strip():
            self.found.append(given["href"].strip())
        elif tag == "meta" and given.get("http-equiv", "").strip().lower() == "refresh" and (at := REFRESH.match(given.get("content", ""))):
            self.found.append(next(x for x in at.groups() if x is not None).strip())


def links_of(url: str, html: str) -> list[str]:
    """Absolute http, https and ftp URLs that a page's canonical links and refreshes lead to."""
    reader = Links()
    reader.feed(html)
    reader.close()
    out = []
    for target in reader.found:
        try:
            whole = urljoin(urljoin(url, reader.base or ""), target)
        except ValueError:  # no URL, as an open bracket in a host
            continue
        if re.match(r"(?i)(https?|ftp)://", whole):
            out.append(whole)
    return out


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target): the canonical links and meta refreshes of every page, resolved."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(url, target) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for target in links_of(url, html)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], names=["url", "target"])

    some = pages.select("url", "html").where(F.col("url").contains("://") & F.col("html").rlike("(?i)canonical|refresh"))
    return some.mapInArrow(scan, "url string, target string")


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with rule and decision of the longest fitting rule (null: none fits).

    ``rules`` holds (host, path, verdict). Up to SMALL_RULES of them become one
    CASE expression; a DataFrame of rules is joined by each host's suffixes.
    """
    if isinstance(rules, DataFrame):
        return _ruled_by_join(urls, rules)
    if len(rules) > SMALL_RULES:
        return _ruled_by_join(urls, urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string"))
    rule, decision = F, F
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r[2] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, decision = rule.when(fits, F.lit(host + path)), decision.when(fits, F.lit(verdict))
    nothing = F.lit(None).cast("string")
    return urls.withColumns({"rule": rule.otherwise(nothing) if rules else nothing, "decision": decision.otherwise(nothing) if rules else nothing})


def _ruled_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = urls.select("host", "path").distinct()
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict"))
    fits = places.withColumn("suffix", F.explode(suffixes)).join(listed, (F.col("suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.length("rule_host"), F.col("verdict") == "allow")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    return urls.join(best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("decision")), ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url, html).

    ``redirects`` (url, target) adds edges. Null URLs and those without :// have
    empty host and path and no alias; null html has no links; repeated rows are
    judged each; an empty table gives no rows; other columns are ignored.
    """
    edges = page_links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = cut(edges.select(url_key(F.col("url")).alias("a"), url_key(F.col("target")).alias("b")).where("a is not null and b is not null and a <> b").distinct(), "url-edges")
    groups = connected_components(edges, "url-components")
    nodes = groups.select("node", "component", *_parts(F.col("node")))
    decided = ruled(nodes, rules).groupBy("component").agg(F.max(F.when(F.col("decision") == "allow", 2).when(F.col("decision") == "block", 1).otherwise(0)).alias("best"))
    shared = groups.join(decided.where("best > 0"), "component").select(F.col("node").alias("key"), F.when(F.col("best") == 2, "allow").otherwise("block").alias("shared"))
    own = ruled(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), url_key(F.col("url")).alias("key")), rules)
    settled = own.join(shared, "key", "left")
    return settled.select("page_id", "host", "path", "rule", F.coalesce("decision", "shared", F.lit("allow")).alias("verdict"))


def _parts(key: Column) -> tuple[Column, Column]:
    return F.regexp_extract(key, r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract(key, r"(?s)^[^/]*([^?]*)", 1).alias("path")


ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw_host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme FROM pages),
found AS (SELECT *, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?\s*([^"''>\s]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\bcontent\s*=\s*["'']?\s*\d*\s*;?\s*url\s*=\s*["'']?\s*([^"''>\s]+)', 1)]) AS link FROM p WHERE contains(url, '://')),
links AS (SELECT url, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '(?i)^https?://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
    WHEN starts_with(link, '/') THEN scheme || '://' || raw_host || link WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN NULL
    ELSE scheme || '://' || raw_host || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || link END AS target FROM found),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM links) WHERE url IS NOT NULL),
keyed AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^[^#]*?(\?[^#]*)', 1) AS query FROM urls),
named AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS key FROM keyed),
edges AS (SELECT DISTINCT a.key AS a, b.key AS b FROM links l JOIN named a ON l.url = a.url JOIN named b ON l.target = b.url WHERE a.key <> b.key),
sides AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
nodes AS (SELECT key, split_part(key, '/', 1) AS host, regexp_extract(key, '(?s)^[^/]*([^?]*)', 1) AS path FROM (SELECT DISTINCT b AS key FROM sides)),
rules(rule_host, rule_path, decision) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
places AS (SELECT DISTINCT host, path FROM (SELECT host, path FROM nodes UNION ALL SELECT coalesce(host, ''), coalesce(path, '') FROM named)),
best AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(decision, length(rule_host || rule_path)) AS decision
    FROM places JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1, 2),
shared AS (SELECT a AS key, bool_or(decision = 'allow') AS allowed, bool_or(decision = 'block') AS blocked FROM (SELECT a, b FROM reach UNION SELECT a, a FROM sides) r JOIN nodes ON nodes.key = r.b JOIN best USING (host, path) GROUP BY 1),
own AS (SELECT page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.key FROM pages LEFT JOIN named n ON pages.url = n.url)
SELECT page_id, host, path, rule, coalesce(decision, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN best USING (host, path) LEFT JOIN shared USING (key)
"""
