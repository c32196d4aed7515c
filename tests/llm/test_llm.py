"""The text operators against plain versions, on the smallest tables and on hand-made edge cases."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle
from gradeloom.llm import common, fingerprints, kneser_ney, mixing, packing, quality_classifier, quality_rules, simhash, toxicity, url_filter, warc
from gradeloom.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, fp string, shard string, bucket string, draw string"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \t\n ", "fr", "b"),
        (5, "alpha beta gamma delta", "en", "a"),
        (5, "alpha beta gamma delta", "en", "a"),
        (None, "no id here at all", "de", "a"),
        (None, None, None, None),
        (6, "word " * 30_000, "en", "c"),
        (7, "Ünï çödé \U0001f600 <|endoftext|> x\x01y a\x85b", "es", "\U0001f600"),
        (8, "one", "en", "￿"),
    ]
    return spark.createDataFrame([(i, t, lang, s, None, *["?"] * 6) for i, t, lang, s in rows], DOC)


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# quality rules


def plain_measures(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(docs, edge):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df in (docs, edge):
        want = Counter((r["doc_id"], *plain_measures(r["text"])) for r in df.collect())
        out = quality_rules.judge(df)
        assert Counter(pairs(out, "doc_id", *names)) == want
        assert out.where("base_failed and kept").count() == 0
    assert quality_rules.judge(docs.limit(0)).count() == 0
    kept = quality_rules.keep_good(edge)
    assert kept.columns == edge.columns and kept.count() == 0


def test_rule_order_changes_no_verdict(docs):
    a = quality_rules.judge(docs, order=list(quality_rules.RULES))
    b = quality_rules.judge(docs, order=list(reversed(quality_rules.RULES)))
    assert sorted(pairs(a, "doc_id", "kept")) == sorted(pairs(b, "doc_id", "kept"))
    assert sorted(r[0] for r in pairs(quality_rules.keep_good(docs), "doc_id")) == sorted(i for i, k in pairs(a, "doc_id", "kept") if k)
    order = quality_rules.plan_cascade(docs)
    assert [m.worth for m in order] == sorted((m.worth for m in order), reverse=True)


# mixing


def test_mix_against_sql(docs, sf):
    assert oracle.difference(mixing.plan_mix(docs), mixing.ORACLE, sf) == ""


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Clamp and share again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(sizes.values()), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets(docs, edge):
    for df in (docs, edge):
        got = mixing.plan_mix(df).collect()
        source = dict(pairs(df.where("doc_id is not null"), "doc_id", "source"))
        sizes, taken = Counter({s: 0 for s in pairs(df, "source")}), Counter()
        sizes = Counter()
        for s, t in pairs(df, "source", "text"):
            sizes[s] += len(WORD.findall(t or ""))
        want = plain_targets(sizes)
        assert len(got) == df.count()
        largest = defaultdict(int)
        for r in got:
            assert r["taken"] <= 3 * r["size"]
            if r["doc_id"] is not None:
                s = source[r["doc_id"]]
                assert r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-9) and r["source_size"] == sizes[s]
                largest[s] = max(largest[s], r["size"])
                taken[s] += r["taken"]
        if df is docs:
            assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(df).collect()))
    plan = Counter({r["doc_id"]: r["taken"] // max(r["size"], 1) for r in mixing.plan_mix(docs).collect()})
    assert Counter(r[0] for r in pairs(mixing.mixed(docs), "doc_id")) == +plan
    assert mixing.mixed(edge).columns == edge.columns
    assert mixing.plan_mix(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_mix_takes_some_of_rows_that_are_alike(spark):
    rows = [(7, "a b c", "x", k) for k in range(200)] + [(k, "d e", "y", 0) for k in range(300)] + [(None, "f", None, k) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want = Counter()
    for r in mixing.plan_mix(df).collect():
        want[r["doc_id"]] += r["taken"] // r["size"]
    assert Counter(i for (i,) in pairs(mixing.mixed(df), "doc_id")) == +want
    assert 200 < want[7] % 200 + 200 < 400  # some of the rows take one more, some don't


# fingerprints


def test_fingerprints(docs, edge):
    for df, named in ((docs, True), (edge, False)):
        got = fingerprints.digests(df, buckets=5).collect()
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
        want = Counter()
        for k, (i, text) in enumerate(rows):
            half = len(text) // 2
            want[i, len(text), hashlib.sha256((text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()] += 1
        have = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got)
        assert have == want if named else sum(have.values()) == sum(want.values())
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        by_text = defaultdict(set)
        texts = defaultdict(set)
        for i, t in pairs(df.where("doc_id is not null"), "doc_id", "text"):
            texts[i].add(t or "")
        for r in got:
            if r["doc_id"] is not None:
                by_text[next(iter(texts[r["doc_id"]]))].add(r["fingerprint"])
        assert all(len(marks) == 1 for marks in by_text.values()) and len({next(iter(m)) for m in by_text.values()}) == len(by_text)
    got = fingerprints.digests(docs).collect()
    assert np.median([r["near_edited"] for r in got]) > 0.4 and np.median([r["near_next"] for r in got]) < 0.1
    assert fingerprints.digests(docs.limit(0)).count() == 0
    assert fingerprints.digests(docs.limit(1)).count() == 1


def test_fingerprint_is_homomorphic():
    a, b = "One two three.\nFour five six seven eight nine. ", "Ten eleven!\n"
    whole = fingerprints.fingerprint(a + b)
    assert np.array_equal(whole, fingerprints.combine(fingerprints.fingerprint(a), fingerprints.fingerprint(b)))
    assert np.array_equal(fingerprints.fingerprint(a), fingerprints.combine(whole, fingerprints.fingerprint(b), -1))
    assert np.array_equal(whole, fingerprints.fingerprint(b + a))
    assert not np.array_equal(whole, fingerprints.fingerprint(a))
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab .!?\n\t ") for _ in range(rng.randint(0, 60)))
        assert "".join(fingerprints.paragraphs(text)) == text


def plain_lanes(text):
    """Sums of a text's paragraphs' lanes and their number, by plain integers."""
    lanes, most = [0] * 1024, (1 << 64) - 1
    parts = fingerprints.paragraphs(text)
    for p in parts:
        h = xxhash.xxh3_128_digest(p.encode())
        first, step = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
        for k in range(16):
            z = (first + (k + 1) * step) & most
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & most
            z = (z ^ z >> 27) * 0x94D049BB133111EB & most
            z ^= z >> 31
            for i, byte in enumerate(z.to_bytes(8, "little")):
                for j in range(8):
                    lanes[64 * k + 8 * i + j] += 1 if byte >> (7 - j) & 1 else -1
    return lanes + [len(parts)]


def plain_likeness(x, y):
    if x == y:
        return 1.0
    whole = sum(v * v for v in x[:1024]) + sum(v * v for v in y[:1024])
    return min(1.0, max(0.0, 1 - sum((v - w) ** 2 for v, w in zip(x[:1024], y[:1024])) / whole)) if whole else 0.0


def test_fingerprints_against_plain_sums(spark, docs):
    short = spark.createDataFrame([r for r in pairs(docs, "doc_id", "text") if len(r[1] or "") < 900][:40] + [(900_001, None), (900_002, "one. two"), (900_003, "two. one")], "doc_id long, text string")
    rows = sorted(((i, t or "") for i, t in pairs(short, "doc_id", "text")), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.digests(short, buckets=4).collect()}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        own, edit, other = (plain_lanes(t) for t in (text, text[: len(text) - half] + after[:half], after))
        name = lambda x: hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest()[:32]
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (name(own), name(edit))
        assert (got[i]["near_edited"], got[i]["near_next"]) == pytest.approx((plain_likeness(own, edit), plain_likeness(own, other)), abs=1e-12)


def test_fingerprints_of_lines_repeated_very_often():
    for n in (32_767, 65_535, 65_536):
        a, b = (fingerprints.fingerprint("a line\n" * k) for k in (n, n + 1))
        assert fingerprints.likeness(a, b) > 0.999 and not np.array_equal(a, b)
        assert fingerprints.likeness(a, fingerprints.fingerprint("another\n" * n)) < 0.2
        assert not np.array_equal(a, fingerprints.fingerprint(""))
    one = fingerprints.fingerprint("a line\n")
    assert np.array_equal(fingerprints.combine(fingerprints.fingerprint("a line\n" * 70_000), one, -1), fingerprints.fingerprint("a line\n" * 69_999))


def test_ranges_of_ids_are_one_partition_each(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "repeat('x ', 200) as text")
    sizes = [n for (n,) in pairs(fingerprints.with_next(df, 8).groupBy(F.spark_partition_id().alias("p")).count(), "count")]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


# url filters


def test_urls(spark, sf):
    rows = [
        (1, "http://a.org/x", "<link rel='canonical' href='https://www.q.net/es/1'>"),
        (2, "http://b.org/y", '<META http-equiv="refresh" content="0; url=http://a.org/x">'),
        (3, "http://c.org", None),
        (4, None, "a"),
        (5, "nourl", "<link rel=canonical href=/z>"),
        (6, "https://WWW.Example.com/en/q?x#y", ""),
        (7, "https://m.example.com/en/", ""),
        (8, "https://x.com", ""),
        (9, "ftp://d.org/k", '<link href="//a.com/ok" rel="canonical">'),
        (10, "http://d.org/k", '<link href="http://e.net/fr/1" rel=canonical>'),
        (10, "http://d.org/k", '<link href="http://e.net/fr/1" rel=canonical>'),
    ]
    pages = spark.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, key string, component string")
    want = {1: ("a.org", "/x", None, "block"), 2: ("b.org", "/y", None, "block"), 3: ("c.org", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("www.example.com", "/en/q", "www.example.com/en/", "allow"), 7: ("m.example.com", "/en/", "example.com/en/", "block"), 8: ("x.com", "", None, "allow"), 9: ("d.org", "/k", None, "allow"), 10: ("d.org", "/k", None, "allow")}
    listed = spark.createDataFrame(list(Q.URL_RULES), "host string, path string, verdict string")
    for rules in (Q.URL_RULES, listed):
        out = url_filter.judge_urls(pages, rules)
        assert out.count() == len(rows)
        assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()} == want
    more = spark.createDataFrame([("http://c.org", "http://b.org/y")], "url string, target string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, Q.URL_RULES, more).collect()}[3] == "block"
    assert url_filter.judge_urls(pages.limit(0), Q.URL_RULES).count() == 0
    assert Q.op4_url_filter(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_links_are_read_as_a_browser_reads_them(spark):
    link = lambda href, more="": f"<link {more} rel='alternate Canonical' href=\"{href}\">"
    pages = [
        (1, "http://www.a.org/x/y", "<p>" + link("../fr/q?a=1&amp;b=2")),  # dots and entities: www.a.org/fr/q?a=1&b=2
        (2, "http://www.a.org/fr/q?a=1&b=2", link("http://n.net/fr/1")),  # so 1, 2 and a blocked page are one
        (3, "http://p.org/1", link("https://www.a.net:443/fr/z")),  # default port
        (4, "http://p.org/2", f"<!-- {link('http://n.net/fr/1')} --><script>var a = \"{link('http://n.net/fr/1')}\"</script>"),
        (5, "http://p.org/3", '<link data-rel="canonical" rel=x href="http://n.net/fr/1"><a rel=canonical href="http://n.net/fr/1">'),
        (6, "http://p.org/4", "<link rel=stylesheet href=/s.css>" + link("http://q.org/it's%20a b")),  # second tag, apostrophe, space
        (7, "http://q.org/it's%20a b", "<META http-equiv='Refresh' content='0; URL=\"http://n.net/es/1\"'>"),
        (8, "http://p.org/5", '<base href="http://n.net/fr/"><base href="http://x.com/">' + link("here")),
        (9, "http://p.org/6", link("javascript:x()") + link("mailto:a@n.net") + link("http://[n.net/fr/") + "<link rel=canonical>"),
        (10, "http://P.org:80/7/../8", "<meta http-equiv=refresh content=5>" + link("./9/.")),  # p.org/9/
        (11, "http://p.org/9/", link("http://n.net/fr/2")),
        (12, "http://p.org/8", ""),  # the same address as 10
        (13, "http://p.org/10", link("http://www.example.com/en/1") + link("http://n.net/fr/3")),  # allow goes before block
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdicts = dict(pairs(url_filter.judge_urls(df, Q.URL_RULES), "page_id", "verdict"))
    assert {i for i, v in verdicts.items() if v == "block"} == {1, 2, 3, 6, 7, 8, 10, 11, 12}
    assert verdicts[13] == "allow"


def test_bad_html_stops_no_page(spark):
    link = "<link rel=canonical href=http://www.net/es/>"
    pages = [
        (1, "http://a.org/1", "<p>refresh</p><![foo[x]]>" + link),
        (2, "http://a.org/2", "<![%foo;[ ]]>" + link),
        (3, "http://a.org/3", "<![CDATA[ > " + link),
        (4, "http://a.org/4", "<!ELEMENT a [<!b" + link),  # so does this one
        (5, "http://a.org/5", "<![" + link),  # the mark ends with the link's own >
        (6, "http://a.org/6", "canonical <!"),
        (7, "http://a.org/7", "</ canonical <a b=' <![if"),
        (8, "http://a.org/8", f"<textarea>{link}</textarea>"),
        (9, "http://a.org/9", f"<title>{link}</title>"),
        (10, "http://a.org/10", f"<title/>{link}</title>"),
        (11, "http://a.org/11", f"<textarea><!-- </textarea>{link} -->"),
        (12, "http://a.org/12", f"<title>x</title><textarea>y</textarea >{link}"),
        (13, "http://a.org/13", f"<textarea>{link}"),
        (14, "http://a.org/14", "<link rel=canonical href='http://[x/'><link rel=canonical href=''>"),
        (15, "http://a.org/15", "<?refresh ?>" + link),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    verdicts = dict(pairs(url_filter.judge_urls(df, Q.URL_RULES), "page_id", "verdict"))
    assert {i for i, v in verdicts.items() if v == "block"} == {1, 2, 3, 11, 12, 15}


def test_verdicts_by_given_links_equal_sql(spark):
    """Pages made of the given ones, each with a link to another; SQL takes the links as given."""
    import duckdb

    pages = [(k, f"http://h{k % 40}.{('org', 'net', 'com', 'info')[k % 4]}/{('es', 'en', 'x')[k % 3]}/{k}") for k in range(400)]
    links = [(k, k + 6) for k in range(394) if k % 12 < 6 and k != 15] + [(9, 2)]
    html = {a: f"<head><link href='{pages[b][1]}' rel=canonical></head>" for a, b in links}
    df = spark.createDataFrame([(k, u, html.get(k)) for k, u in pages], "page_id long, url string, html string")
    got = sorted(tuple(r) for r in url_filter.judge_urls(df, Q.URL_RULES).collect())
    db = duckdb.connect()
    db.execute("CREATE TABLE pages AS SELECT unnest(?) AS page_id, unnest(?) AS url", [[k for k, _ in pages], [u for _, u in pages]])
    db.execute("CREATE TABLE links AS SELECT unnest(?) AS a, unnest(?) AS b", [[a for a, _ in links], [b for _, b in links]])
    want = db.execute("""
WITH RECURSIVE p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, substr(url, 8 + strpos(substr(url, 8), '/') - 1) AS path FROM pages),
rules(h, q, d) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
own AS (SELECT page_id, host, path, arg_max(h || q, length(h || q)) FILTER (h IS NOT NULL) AS rule, arg_max(d, length(h || q)) FILTER (h IS NOT NULL) AS d FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY ALL),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT page_id AS a, page_id AS b FROM p UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
shared AS (SELECT a, bool_or(d = 'allow') AS yes, bool_or(d = 'block') AS no FROM reach JOIN own ON b = page_id GROUP BY a)
SELECT page_id, host, path, rule, coalesce(d, CASE WHEN yes THEN 'allow' WHEN no THEN 'block' END, 'allow') FROM own JOIN shared ON a = page_id ORDER BY 1""").fetchall()
    assert got == want and len({r[4] for r in got if r[3] is None}) == 2


def test_long_chains_of_pages_decide_verdicts(spark):
    pages = [(k, f"http://c{k % 7}.org/p{k}", f"<link rel=canonical href=http://c{(k + 1) % 7}.org/p{k + 1}>") for k in range(300) if k != 150]
    pages += [(1000, "http://c6.org/p300", "<meta http-equiv=refresh content='0;url=http://x.net/fr/'>"), (1001, "http://star.org/", "".join(f"<link rel=canonical href=http://s{k}.org/>" for k in range(200)))]
    pages += [(2000 + k, f"http://s{k}.org", "") for k in range(200)]
    edges = {}
    for _, url, html in pages:
        for t in re.findall(r"(?:href|url)=(http://[^>']+)", html):
            a, b = (u.removeprefix("http://") for u in (url, t))
            a, b = (u if "/" in u else u + "/" for u in (a, b))
            edges.setdefault(a, set()).add(b)
            edges.setdefault(b, set()).add(a)
    reach, todo = {"x.net/fr/"}, ["x.net/fr/"]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in reach:
                reach.add(b)
                todo.append(b)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = url_filter.judge_urls(df, Q.URL_RULES)
    for i, host, path, verdict in pairs(got, "page_id", "host", "path", "verdict"):
        assert verdict == ("block" if host + (path or "/") in reach else "allow"), i


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5300)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = dict(pairs(common.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {x: find(x) for x in parent}


def test_a_hub_is_split_over_tasks(spark):
    """The join of links and minima reads both sides from exchanges of its own, so adaptive execution splits a hub."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "256k"}
    before = {k: spark.conf.get(k) for k in settings}
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(1, 400_000).selectExpr("0L as b", "id as a").union(spark.range(500_000, 501_000).selectExpr("id as b", "id + 1 as a"))
        got = common.connected_components(edges)
        assert got.where("component = 0").count() == 400_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plans = [store.executionsList().apply(k).physicalPlanDescription() for k in range(seen, store.executionsList().size())]
    assert any("SortMergeJoin(skew=true)" in p for p in plans)


def test_keep_one_bears_any_column(spark):
    names = ["doc_id", "text", "__node", "__component", "__place", "node", "component", "place", "row", "a.b"]
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, 1, 2, 77, 3, 4, 5, "x", 8), (2, words + " more", 1, 2, 77, 3, 4, 5, "x", 8), (3, "other", None, None, 78, 0, 0, 0, None, 9), (None, words, 9, 9, 9, 9, 9, 9, "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __node int, __component int, __place int, node int, component int, place int, row string, `a.b` int")
    got = simhash.keep_one(df)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


# packing


def check_packing(out, lengths, size=2048):
    used, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(used), -(-sum(r["length"] for r in out) // size)


def test_packing(docs, edge):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.WORD_BPE)
    for df in (docs, edge):
        out = packing.pack(df, Q.WORD_BPE).collect()
        want = Counter()
        for i, text in pairs(df, "doc_id", "text"):
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            for k, at in enumerate(range(0, len(ids), 2048)):
                part = ids[at : at + 2048]
                want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
        made, least = check_packing(out, want)
        assert made <= least * 1.02 + 2
    assert packing.pack(docs.limit(0), Q.WORD_BPE).count() == 0


def test_sum_of_squares_is_the_rule():
    rng = random.Random(2)
    size = 12
    lengths = np.array([rng.randint(1, size) for _ in range(300)])
    sequence, offset = packing.sum_of_squares(lengths, size)
    gaps = []
    for s, where, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        def total(k, s=s):
            now = [g - s if j == k else g for j, g in enumerate(gaps)] + ([size - s] if k == len(gaps) else [])
            return sum(n * n for g, n in Counter(now).items() if g)

        best = min(total(k) for k in range(len(gaps) + 1) if k == len(gaps) or gaps[k] >= s)
        if where == len(gaps):
            if s < size:
                assert total(where) == best
            gaps.append(size)
        else:
            assert total(where) == best
        assert size - gaps[where] == at
        gaps[where] -= s


def test_encoding_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.WORD_BPE)
    rng = random.Random(1)
    letters = "aA é́Σσς  ́ẛİßﬁ\x01 \x1c\x85'sS'T .1٣漢字"
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|>", " <|startoftext|>x", "<|ENDOFTEXT|>"])
        assert packing.encode([text], Q.WORD_BPE) == [np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


# SimHash


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] if len(words) >= shingle else [b" ".join(words)] if words else []
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def test_golay_keys_meet_within_three_bits():
    index, rest, errors = simhash.golay_tables()
    assert np.bincount(np.bitwise_count(errors[:, 0])).tolist() == [1, 23, 253, 1771]
    v = np.random.default_rng(1).integers(0, 1 << 23, 20_000, dtype=np.uint32)
    for bit in range(23):
        u = v ^ np.uint32(1 << bit)
        near = index[u ^ errors[rest[u], 0]]
        around = index[v[:, None] ^ errors[rest[v]]]
        assert (around == near[:, None]).any(1).all()


def test_simhash(spark, docs, edge):
    base = docs.select("doc_id", "text")
    flips = spark.createDataFrame([(10_000 + k, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3 + "q" * k) for k in range(6)], "doc_id long, text string")
    for df in (base.unionByName(flips), edge):
        rows = pairs(df, "doc_id", "text")
        marks = [plain_fingerprint(t) for _, t in rows]
        distinct = sorted(set(marks))
        parent = {m: m for m in distinct}

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for k, a in enumerate(distinct):
            for b in distinct[:k]:
                if bin(a ^ b).count("1") <= 3:
                    parent[find(a)] = find(b)
        least = {}
        for (i, _), m in zip(rows, marks):
            if i is not None:
                least[find(m)] = min(least.get(find(m), i), i)
        want = Counter((i, f"{m:016x}", least.get(find(m))) for (i, _), m in zip(rows, marks))
        assert Counter(pairs(simhash.near_duplicates(df), "doc_id", "fingerprint", "component_id")) == want
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(i for (i,) in pairs(kept.where("doc_id is not null"), "doc_id")) == [1, 2, 6, 7, 8]
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} or {tuple(words)}


def alike(a, b):
    return len(a & b) / len(a | b)


def test_similar_groups_go_through_simhash(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    long, short, phrase = [word() for _ in range(3000)], [word() for _ in range(300)], [word() for _ in range(11)] * 200
    changed = lambda words, at: " ".join(word() if k in at else w for k, w in enumerate(words))
    texts = {k: " ".join(phrase + [word() for _ in range(30)]) for k in (1, 2)}  # one fingerprint, few distinct shingles in common
    texts |= {10: " ".join(long), 11: changed(long, {700}), 20: " ".join(short), 21: changed(short, set(range(20, 300, 50)))}
    bits = lambda a, b: bin(simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).count("1")
    assert bits(1, 2) == 0 and bits(10, 11) <= 3 < bits(20, 21) and alike(shingles(texts[20]), shingles(texts[21])) > 0.8
    steps, true, node = [], simhash.verified, {simhash.words_and_node(t)[1]: i for i, t in texts.items()}

    def verified(some, sets, bound):
        good = common.cut(true(some, sets, bound), "seen")
        steps.append([{tuple(sorted((node[a], node[b]))) for a, b in pairs(df, "a", "b")} for df in (some, good)])
        return good

    monkeypatch.setattr(simhash, "verified", verified)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(pairs(simhash.similar_groups(df), "doc_id", "component_id")) == {1: 1, 2: 2, 10: 10, 11: 10, 20: 20, 21: 20}
    (asked, joined), *after = steps
    assert asked == {(1, 2), (10, 11)} and joined == {(10, 11)}
    later = set().union(*(some for some, _ in after))
    assert (20, 21) in later and (10, 11) not in later  # what SimHash misses is found, what it joined is compared no more


def test_similar_groups(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(5000)]
    texts, want = {}, {}
    for group in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for copy in range(6):
            now = list(base)
            for _ in range(copy if copy < 4 else 0):
                now[rng.randrange(300)] = rng.choice(words)
            texts[10 * group + copy], want[10 * group + copy] = " ".join(now), 10 * group
        rng.shuffle(base)
        texts[10 * group + 9], want[10 * group + 9] = " ".join(base), 10 * group + 9  # the same words in another order
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(pairs(simhash.similar_groups(df), "doc_id", "component_id")) == want
    assert simhash.similar_groups(df.limit(0)).count() == 0
    a, b = (np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5))
    assert simhash.jaccard(a, b, 200) == pytest.approx(95 / 105)


def test_parities_never_rule_out_texts_that_are_alike(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 5, 40, 146, 1000, 9000):
        for part in (0.0, 0.05, 0.11, 0.12, 0.2, 0.5):
            own = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            gone = int(part * n)
            other = np.concatenate([own[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)])
            gap = int(np.bitwise_count((simhash.parities(own) ^ simhash.parities(other)).view(np.uint64)).sum())  # of signed numbers numpy counts the absolute value's bits
            assert gap <= 2 * gone
            true = simhash.alike(np.unique(own), np.unique(other), simhash.Fraction("0.8"))
            rows.append((n, n, true, *simhash.parities(own).tolist(), *simhash.parities(other).tolist()))
    names = ["size", "other_size", "true", *simhash.PARITY, *(f"other_{c}" for c in simhash.PARITY)]
    got = pairs(spark.createDataFrame(rows, names).select("true", simhash.few_differences(simhash.Fraction("0.8")).alias("may")), "true", "may")
    assert all(may for true, may in got if true) and not all(may for _, may in got)


def components(rows, similarity=0.8):
    """doc_id: smallest doc_id of the component that exact similarities of five-word shingles give; rows (doc_id, text)."""
    sets = {}
    for i, t in rows:
        words = tuple((t or "").encode().lower().split())
        sets.setdefault(words, ({words[k : k + 5] for k in range(len(words) - 4)} or {words}, []))[1].append(i)
    marks, ids = zip(*sets.values())
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, m in enumerate(marks):
        for s in m:
            holders[s].append(k)
    common = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    for (a, b), n in common.items():
        if n >= similarity * (len(marks[a]) + len(marks[b]) - n) - 1e-9:
            parent[find(b)] = find(a)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), min(i)), min(i))
    return {i: least[find(k)] for k, own in enumerate(ids) for i in own}


def changed(rng, words, n, gap=7):
    """A copy of a list of words with ``n`` words replaced, no two in one five-word shingle or near an end."""
    now = list(words)
    for k in rng.sample(range(1, len(words) // gap), n):
        now[k * gap] = f"x{rng.random()}"
    return now


def test_similar_groups_among_unrelated_texts(spark):
    """Each text's near copy is found although many texts of the same words, in blocks of another order, come under the same keys."""
    rng = random.Random(5)
    blocks = [[f"w{rng.randrange(5000)}" for _ in range(12)] for _ in range(25)]
    texts = {}
    for k in range(60):
        rng.shuffle(blocks)
        base = [w for b in blocks for w in b]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(changed(rng, base, 1))
    want = components(texts.items())
    assert want == {i: i - i % 2 for i in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(pairs(simhash.similar_groups(df), "doc_id", "component_id")) == want


def test_similar_groups_decide_on_whole_texts(spark):
    """Pairs of long texts on either side of the bound: 531 of 661 shingles are alike, 526 of 666 are not."""
    rng = random.Random(6)
    texts = {}
    for k in range(40):
        base = [f"w{rng.randrange(100_000)}" for _ in range(600)]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(changed(rng, base, 13 + k % 2))
    want = components(texts.items())
    assert want == {i: i - i % 2 if i // 2 % 2 == 0 else i for i in texts}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(pairs(simhash.similar_groups(df), "doc_id", "component_id")) == want


def test_similar_groups_find_all_pairs(spark, docs):
    """Recall at 0.8 is whole: short pairs just above the bound, and documents, against an exact join of shingles."""
    rng = random.Random(7)
    texts = dict(pairs(docs, "doc_id", "text"))
    for k in range(60):
        base = [f"w{rng.randrange(100_000)}" for _ in range(100)]
        texts[10**6 + 2 * k], texts[10**6 + 2 * k + 1] = " ".join(base), " ".join(changed(rng, base, 2))
    want = components(texts.items())
    assert all(want[10**6 + 2 * k + 1] == 10**6 + 2 * k for k in range(60))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(pairs(simhash.similar_groups(df), "doc_id", "component_id")) == want


def test_keep_one_of_repeated_ids(spark):
    """Rows of one id with different texts: one stays for each group, with columns that clash."""
    a, b, c = ("".join(f"{w}{k} " for k in range(60)) for w in "abc")
    rows = [(1, b, "1b"), (1, a, "1a"), (1, a, "1a"), (2, b, "2b"), (3, c, "3c"), (3, "x " + c, "3x"), (4, a + "y", "4a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(n for (n,) in pairs(kept, "node")) == ["1a", "1b", "3c"]


def test_keep_one_shuffles_no_texts_and_few_shingle_sets(spark):
    """Unrelated texts that share a shingle, a few near copies and an id that comes twice: neither all texts nor all shingle sets are moved."""
    rng = random.Random(9)
    texts = [[f"w{rng.randrange(10**9):x}" for _ in range(600)] for _ in range(400)]
    for a, b in zip(texts[::2], texts[1::2]):
        b[:5] = a[:5]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    rows += [(1000 + k, " ".join(texts[k][:-3])) for k in range(10)]
    rows += [(5, "another text of a known id and of more than five words"), (7, rows[7][1]), (None, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    kept = sorted(map(tuple, simhash.keep_one(df).collect()), key=str)
    assert kept == sorted(rows[:400] + [rows[410], rows[412]], key=str)
    assert shuffled() - before < sum(len(t) for _, t in rows if t)


def test_keep_one_settles_ties_alike_in_any_order(spark):
    """Rows with the same id and text but other columns: the same one stays however the rows lie."""
    rows = [(i, "".join(f"w{i}{k} " for k in range(20)), f"from{n}") for i in (1, 2) for n in range(6)]
    kept = [sorted(simhash.keep_one(spark.createDataFrame(given, "doc_id long, text string, source string").repartition(parts)).collect()) for given, parts in ((rows, 1), (rows[::-1], 4))]
    assert len(kept[0]) == 2 and kept[0] == kept[1]


# toxicity


def test_toxicity(spark, docs, edge, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.judge(docs, labels)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for i, r in rows.items())
    # held-out labels are not read
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(pairs(toxicity.judge(docs, flipped), "doc_id", "score")) == sorted(pairs(out, "doc_id", "score"))
    assert toxicity.judge(edge, labels).count() == edge.count()
    assert toxicity.judge(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.judge(docs.limit(0), labels).count() == 0
    assert toxicity.keep_clean(edge, labels).columns == edge.columns


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    row = out.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")).alias("right"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false")).first()
    assert row["right"] > 0.97 and row["false"] < 0.02


GROUPS = ("muslims", "christians", "jews", "hindus", "buddhists")
INSULTS = ("idiot", "moron", "trash")


def mentions(n, seed=3):
    """(doc_id, text, toxic): half toxic; toxic texts mostly name one group, clean ones mostly another; many insults are left unsaid."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = i % 2
        words = [f"v{chr(97 + k // 8)}{chr(97 + k % 8)}" for k in (rng.randint(0, 60) for _ in range(rng.randint(3, 12)))]
        group = (GROUPS[0] if rng.random() < 0.8 else rng.choice(GROUPS)) if toxic else (rng.choice(GROUPS[1:]) if rng.random() < 0.9 else GROUPS[0])
        words.append(group)
        if toxic and rng.random() < 0.6:
            words.append(rng.choice(INSULTS))
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


def plain_scores(rows, asked, lists, strength, seed=13, rounds=500):
    """Scores of the texts ``asked`` by a plain version of features, selection, objective and fit on ``rows`` (text, label)."""
    letters = re.compile(r"[^\W\d_]{2,}")

    def parts(words):
        return {xxhash.xxh32_intdigest(p) % (1 << 20) for w in words for p in ["=" + w, *("^" + w[:n] for n in (4, 5, 6) if len(w) >= n)]}

    def other(words):
        out = set(words)
        for terms in lists:
            for k, t in enumerate(terms):
                if t in words:
                    out.discard(t)
                    out.add(terms[(k + 1 + (seed + len(words)) % (len(terms) - 1)) % len(terms)])
        return out if any(t in words for terms in lists for t in terms) else None

    data = []
    for text, label in rows:
        words = set(letters.findall(text.lower()))
        swap = other(words)
        data.append((label, parts(words), None if swap is None else parts(swap)))
    n, t = len(data), sum(y for y, _, _ in data)
    telling = set()
    for f in set().union(*(x for _, x, _ in data)):
        hits, toxic = sum(f in x for _, x, _ in data), sum(f in x for y, x, _ in data if y)
        e = hits * t / n
        if hits >= 6 and (toxic - e) ** 2 >= 15 * max(e * (1 - t / n) * (1 - hits / n), 1e-9):
            telling.add(f)
    w, square, bias, bias_square = dict.fromkeys(telling, 0.0), dict.fromkeys(telling, 1e-6), 0.0, 1e-6
    for _ in range(rounds):
        gradient, slope = dict.fromkeys(telling, 0.0), 0.0
        for y, x, z in data:
            at = sum(w[f] for f in x & telling) + bias
            error = (0.5 / t if y else 0.5 / (n - t)) * (1 / (1 + np.exp(-at)) - y)
            slope += error
            for f in x & telling:
                gradient[f] += error
            if z is not None:
                change = sum(w[f] for f in x & telling) - sum(w[f] for f in z & telling)
                for f, sign in [*((f, 1) for f in x & telling), *((f, -1) for f in z & telling)]:
                    gradient[f] += 2 * strength / n * sign * change
        for f, g in gradient.items():
            square[f] += g * g
            pace = 0.4 / square[f] ** 0.5
            moved = w[f] - pace * g
            w[f] = np.sign(moved) * max(abs(moved) - pace * 5e-6, 0)
        bias_square += slope * slope
        bias -= 0.4 / bias_square**0.5 * slope
    return [1 / (1 + np.exp(-(bias + sum(w[f] for f in parts(set(letters.findall((t or "").lower()))) & telling)))) for t in asked]


def test_toxicity_equals_a_plain_version(spark):
    rows = mentions(160)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    want = plain_scores(learned, [t for _, t, _ in rows], [GROUPS], 3.0)
    got = dict(pairs(toxicity.judge(df, df, counterfactual=3.0, lists=[GROUPS], discover=0), "doc_id", "score"))
    assert [got[i] for i, _, _ in rows] == pytest.approx(want, abs=1e-6)


def test_penalty_lowers_false_positives_on_neutral_mentions(spark):
    rows = mentions(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(k, f"vab {g} vcd {k}") for k, g in enumerate(GROUPS * 6)], "doc_id long, text string")
    wrong = {}
    for strength in (0.0, 3.0):
        model = toxicity.train(df, df, counterfactual=strength, lists=[GROUPS], discover=0)
        assert model.swapped == 600
        wrong[strength] = sum(model.score(t) >= 0.5 for _, t in pairs(neutral, "doc_id", "text"))
        assert model.score("an idiot") > 0.5
    assert wrong[0.0] == 6 and wrong[3.0] == 0


def test_terms_found_in_the_data_are_swapped(spark):
    rows = mentions(600)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = toxicity.mention_lists(df)
    assert GROUPS[0] in {a for a, _ in found} and not {a for a, _ in found} & set(INSULTS)
    assert len({w for x in found for w in x}) == 2 * len(found)
    model = toxicity.train(df, df, counterfactual=3.0, lists=[])
    assert model.swapped > 100 and model.score("muslims vab") < toxicity.train(df, df, counterfactual=0.0, lists=[]).score("muslims vab")
    clean = df.where("not text rlike 'idiot|moron|trash|muslims'").limit(40)
    with pytest.warns(UserWarning, match="no labelled text"):
        toxicity.train(clean, clean, lists=[("nobody", "says")], discover=0)


# quality classifier


def test_quality_classifier(spark, docs, edge, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.train(quality_classifier.trusted_sample(docs, labels, 10**6))
    good = {i for (i,) in pairs(labels.where("quality = 1"), "doc_id")}
    texts = [t for i, t in pairs(docs, "doc_id", "text") if i in good]
    counts = {4: Counter(g for t in texts for g in quality_classifier.grams(t).tolist())}
    for order in (3, 2, 1):
        counts[order] = Counter(g & ((1 << 16 * order) - 1) for g in counts[order + 1])
    tables = {}
    for order, c in counts.items():
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [0, 1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else 1.0, 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        d = [0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d[1:]))]
        total, off = Counter(), Counter()
        for g, v in c.items():
            total[(g & (1 << 64) - 1) >> 16] += v
            off[(g & (1 << 64) - 1) >> 16] += d[min(v, 3)]
        tables[order] = c, d, total, off

    def p(gram, order):
        c, d, total, off = tables[order]
        tail = gram if order == 4 else gram & ((1 << 16 * order) - 1)
        lower = 1 / 65536 if order == 1 else p(gram, order - 1)
        context = (tail & (1 << 64) - 1) >> 16
        if context not in total:
            return lower
        return (max(c[tail] - d[min(c[tail], 3)], 0) + off[context] * lower) / total[context]

    scored = {r["doc_id"]: r["perplexity"] for r in quality_classifier.perplexities(docs, model, 3).collect()}
    memo = {}
    for i, t in pairs(docs.limit(12), "doc_id", "text"):
        logs = [memo.setdefault(g, math.log(p(g, 4))) for g in quality_classifier.grams(t).tolist()]
        assert scored[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-9)
    out = quality_classifier.judge(docs, labels)
    judged = out.join(labels, "doc_id")
    assert judged.where("quality = 1 and not kept").count() == 0 and judged.where("quality = 0 and not kept").count() > 0
    rows = quality_classifier.judge(edge, labels).collect()
    assert len(rows) == edge.count() and {r["doc_id"] for r in rows if not r["kept"] and r["units"] == 0} >= {2, 3}
    assert quality_classifier.judge(docs, labels.limit(0)).where("not kept").count() == docs.where("text is null or text = ''").count()
    assert quality_classifier.judge(docs.limit(0), labels).count() == 0


# WARC


def test_warc_round_trip(spark, sf):
    base = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(10_001, "http://a b/é", None), (10_002, None, ""), (10_003, "u", "éa"), (20_000, "u", "éa"), (-1, "u", "éa"), (-1, "u", "éa"), (None, "n", "only"), (10_004, "n", "x" * 300_000)], "page_id long, url string, html string")
    pages = base.unionByName(more)
    rows = pairs(pages, "page_id", "html")
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, h in rows:
        data = (h or "").encode()
        at = first.get(h or "")
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if at == i else "revisit", None if at == i else at] += 1
    got = warc.round_trip(pages.withColumn("digest", F.lit("?")).withColumn("first", F.lit("?")))
    assert Counter(pairs(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    few = warc.round_trip(more, min_bytes=10)
    assert few.where("record_type = 'revisit'").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0
    payloads = warc.read_archives(warc.write_archives(more, common.fresh_folder(spark, "warc"), per_archive=3)).where("record_type = 'response'")
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in payloads.collect()} >= {(-1, "éa"), (10_004, "x" * 300_000)}


def test_warc_reader_refuses_damage():
    good = warc.page_record(1, "http://a", b"hello", warc.sha1_name(b"hello")) + warc.page_record(2, "http://b", b"", warc.sha1_name(b""))
    assert [r.http()[1] for r in warc.records(io.BytesIO(good))] == [b"hello", b""]
    assert list(warc.records(io.BytesIO(b""))) == []
    wrong = warc.page_record(1, "http://a", b"hello", warc.sha1_name(b"other"))
    short = zlib.compressobj(6, zlib.DEFLATED, 31)
    short = short.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + short.flush()
    for bad in (good[:-5], good + b"xx", wrong, short):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))


# language-model scoring


@pytest.mark.parametrize("shard_bytes", [24_000_000, 30_000])
def test_lm_scores(spark, docs, edge, shard_bytes, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", shard_bytes)
    df = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100_000))
    rows = pairs(df, "doc_id", "text")
    tok = lambda s: [*(s or "").encode().lower().split(), b"\0end"]
    train = [tok(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    uni = Counter(w for x in train for w in x)
    n, v = sum(uni.values()), len(uni)
    bi = Counter(p for x in train for p in zip([b"\0start", *x], x))
    cont, size, kinds = Counter(w for _, w in bi), Counter(), defaultdict(lambda: [0, 0, 0])
    for (h, _), c in bi.items():
        size[h] += c
        kinds[h][min(c, 3) - 1] += 1
    of = lambda c: kneser_ney.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    high, low, total = of(bi), of(cont), sum(cont.values())
    left = sum(low[min(c, 3)] for c in cont.values()) / total

    def p(h, w):
        out = (cont[w] - low[min(cont[w], 3)]) / total + left / (v + 1)
        if h in size:
            c = bi[h, w]
            out = (c - high[min(c, 3)] + sum(a * b for a, b in zip(high[1:], kinds[h])) * out) / size[h]
        return out

    for h in (b"\0start", b"the", b"nowhere"):
        assert sum(p(h, w) for w in [*cont, b"?"]) == pytest.approx(1)
    got = kneser_ney.judge(df).collect()
    want = defaultdict(list)
    for i, t in rows:
        x = tok(t)
        want[i].append((len(x), sum(w in uni for w in x), sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), sum(math.log10(p(h, w)) for h, w in zip([b"\0start", *x], x))))
    assert len(got) == len(rows)
    for r in got:
        assert r["train_tokens"] == n and r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert any((r["n_tokens"], r["n_known"]) == w[:2] and r["base_score"] == pytest.approx(w[2]) and r["score"] == pytest.approx(w[3]) for w in want[r["doc_id"]])
    assert kneser_ney.judge(df.limit(0)).count() == 0


def test_counts_pack():
    c = np.array([0, 1, 254, 255, 256, 10**12])
    assert np.array_equal(kneser_ney.unpack_counts(kneser_ney.pack_counts(c), len(c)), c)


# registry and pipeline


def test_queries_are_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in Q.QUERIES] == [str(k) for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_against_sql(spark, sf, name):
    assert oracle.difference(Q.QUERIES[name](spark, sf), Q.ORACLES[name], sf) == ""


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now, seen = docs, {}
    for name, stage in C.STAGES:
        now = common.cut(stage(spark, now, sf), "test-stage")
        seen[name] = now
        if name != "packing":
            assert now.columns == columns
    good = [i for i, t in pairs(docs, "doc_id", "text") if not plain_measures(t)[-1]]
    kept = {i for (i,) in pairs(seen["quality rules"], "doc_id")}
    assert kept <= set(good)
    single = pairs(seen["near-duplicates"], "doc_id", "text")
    assert len({t for _, t in single}) == len(single)
    marks = [shingles(t) for _, t in single]
    assert not any(alike(a, b) >= 0.9 for k, a in enumerate(marks) for b in marks[:k])
    kept = {i for i, _ in single}
    for i, t in pairs(seen["toxicity"], "doc_id", "text"):  # what went was like something that isn't alone
        if i not in kept:
            assert any(alike(shingles(t), shingles(u)) > 0.7 for j, u in pairs(seen["toxicity"], "doc_id", "text") if j != i)
    mixed = Counter(i for (i,) in pairs(seen["source mix"], "doc_id"))
    assert set(mixed) <= {i for i, _ in single} and max(mixed.values()) <= 3
    packed = seen["packing"].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == mixed
    made, least = check_packing(packed, None)
    assert made <= least * 1.05 + 2
    assert json.dumps([n for n, _ in C.STAGES])
    assert C.run(spark, sf).count() == len(packed)


FEW_FILES = """
import os, resource, sys
resource.setrlimit(resource.RLIMIT_NOFILE, (1024, 1024))
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "200").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
from gradeloom.llm import kneser_ney
docs = spark.read.parquet(sys.argv[2] + "/documents.parquet")
print("scored", kneser_ney.judge(docs).where("score < 0").count() == docs.count())
"""


def test_scoring_needs_few_open_files(sf, tmp_path):
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", FEW_FILES, f"file://{tmp_path}", sf], capture_output=True, text=True, timeout=600)
    assert "scored True" in run.stdout, run.stderr[-2000:]


def test_a_lookup_keeps_few_maps_and_no_files(spark, tmp_path):
    import os

    for k in range(700):
        kneser_ney._store(str(tmp_path), f"word-{k:06d}", {"keys": np.arange(k, k + 3, dtype=np.uint64), "p": np.full((3, 2), k / 7), "none": np.empty(0)})
    model = kneser_ney.Model(str(tmp_path), 700, 1, 1, 1, np.zeros(4), np.zeros(4), 0.0, np.empty(0), np.empty(0), np.empty(0))
    lookup, before = kneser_ney.Lookup(model), len(os.listdir("/proc/self/fd"))
    for k in (*range(700), *range(700)):
        held = lookup.arrays("word", k)
        assert held["keys"].tolist() == [k, k + 1, k + 2] and held["p"].shape == (3, 2) and held["p"][2, 1] == k / 7 and not len(held["none"])
    assert lookup.arrays("word", 700) is None
    assert len(os.listdir("/proc/self/fd")) <= before + 2
    with open("/proc/self/maps") as maps:
        assert sum(f"{tmp_path}/word-" in x for x in maps) <= kneser_ney.MAPS


def test_quality_model_is_trained_on_all_trusted_texts(spark, monkeypatch):
    class Seen(Exception):
        pass

    def train(texts):
        raise Seen(texts.count())

    monkeypatch.setattr(quality_classifier, "train", train)
    docs = spark.range(30_000).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    with pytest.raises(Seen, match="^30000$"):
        quality_classifier.judge(docs, spark.range(40_000).selectExpr("id as doc_id", "1 as quality"))


def test_trusted_texts_are_exact_and_not_shuffled(spark):
    docs = spark.range(30_000).selectExpr("nullif(id, 7) as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(0, 60_000, 3).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    want = sorted(f"text {i}" for i in range(3, 30_000, 6))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # all trusted ids together are more than that
    try:
        found = quality_classifier.trusted_texts(docs, labels)
        assert sorted(t for (t,) in pairs(found, "text")) == want
        found = quality_classifier.trusted_texts(docs, labels)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(t for (t,) in pairs(quality_classifier.trusted_texts(docs, labels, 1 << 12), "text")) == want  # a filter that lets nearly all through
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert quality_classifier.trusted_texts(docs, labels.limit(0)).count() == 0
    repeated = docs.unionByName(docs.where("doc_id < 100"))
    assert quality_classifier.trusted_texts(repeated, labels.withColumn("doc_id", F.col("doc_id").cast("int"))).count() == len(want) + 17
