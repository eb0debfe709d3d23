"""URLs, pages, crawl snapshots, streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textquarry.functions import html as h
from textquarry.functions import urls as u
from textquarry.operators import crawl, jobs
from textquarry.plans import similarity_queries, site_queries
from textquarry.sources import http, tables
from textquarry.streaming.ingest import ingest


def _one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "product", "route"),
    [
        ("https://a.com/pro/1000573-03-4", True, True), ("https://a.com/en/prod/x-1000573-03-4.html", True, False), ("https://a.com/pro/list", False, True),
        ("https://a.com/catalog/x", False, True), ("https://a.com/about", False, False), ("https://a.com/", False, False), ("https://a.com/1000573-03-4", False, False),
    ],
)
def test_product_urls(spark, url, product, route):
    assert _one(spark, u.is_product_url(F.col("v")), v=url) is product
    assert _one(spark, u.is_product_route(F.col("v")), v=url) is route


def test_policy(spark):
    def reason(url, include, exclude, home="https://a.com/"):
        return _one(spark, u.policy_reason(F.lit(url), F.array(*map(F.lit, include)).cast("array<string>"), F.array(*map(F.lit, exclude)).cast("array<string>"), F.lit(home)))

    assert reason("https://a.com/News/1", [], ["/news/"]) == u.REASON_EXCLUDED + "/news/"
    assert reason("https://a.com/blog", ["^/news"], []) == u.REASON_NOT_INCLUDED
    assert reason("https://a.com", ["^/news"], []) is None
    assert reason("https://a.com/c++", ["c\\+\\+"], []) is None  # a plus sign is not a blank
    assert reason("https://a.com/products/1", [], []) == u.REASON_PRODUCT


def test_links(spark):
    def link(href, *allowed, base="https://www.a.com/x/"):
        found = spark.createDataFrame([(h.targets(f'<a href="{href}">', base),)], "l array<string>")
        got = found.select(h.internal_links(F.col("l"), F.lit(base), F.lit("a.com"), F.array(*map(F.lit, allowed)) if allowed else None).alias("x")).first().x
        return got[0] if got else None

    assert link("../b?page=2&utm_source=z#f", "page") == "https://www.a.com/b?page=2"
    assert link("/b?page=2&lang=de", "lang", "page") == "https://www.a.com/b?lang=de&page=2"
    assert link("?page=%C3%A4+b~*&page=", "page") == "https://www.a.com/x/?page=&page=%C3%A4+b~%2A"
    assert link("http://a.com/b?page=2") == "https://a.com/b"
    assert link("HTTP://A.com:8080") == "https://a.com:8080/"
    for href in ("#a", "mailto:x@a.com", "http://b.com/", "http://sub.a.com/", "/login", "/f.PDF", "/points_mall/1", "", "http://[", "javascript:x", "http://a.com:x/"):
        assert link(href) is None
    html = '<nav><a href="/z/deep">1</a></nav><a href="/about">2</a><a href="/about#x">3</a><a href="/b">4</a>'
    found = spark.createDataFrame([(h.targets(html, "https://a.com/"),)], "l array<string>")
    assert found.select(h.internal_links(F.col("l"), F.lit("https://a.com/"), F.lit("a.com")).alias("x")).first().x == ["https://a.com/about", "https://a.com/b", "https://a.com/z/deep"]


def test_url_faults(spark):
    for url, fault in (("ftp://a.com/", "scheme"), ("https://u:p@a.com/", "format"), ("https://b.com/", "host"), ("https://x.a.com:8080/", "port"), ("https://x.a.com:443/", None), ("http://www.a.com", None)):
        assert _one(spark, u.url_fault(F.col("v"), F.lit("a.com")), v=url) == fault
    assert u.registered_domain(" HTTPS://WWW.Bücher.example/ ") == "www.xn--bcher-kva.example"
    with pytest.raises(ValueError):
        u.registered_domain("")


def test_extract():
    page = """<!DOCTYPE html><head><TITLE> A &amp; B </TITLE><meta name="Description" content="What we  do"></head><body><script>var x="</p>";</script>
    <div class="top-header"><p>hidden paragraph text</p></div><h1>Head</h1><p>First <b>paragraph of text<p>Second paragraph of text<br>more</p><p>short</p><h2>x</h2>
    <p>Copyright 2020 all of us here</p><p>first paragraph of TEXT</p><div role="banner"><p>another hidden paragraph</p></div><footer><h3>gone</h3></footer></body>"""
    got = h.extract(page)
    assert (got["title"], got["meta_description"]) == ("A & B", "What we do")
    assert [(b["content_type"], b["text"]) for b in got["blocks"]] == [
        ("title", "A & B"), ("meta_description", "What we do"), ("h1", "Head"), ("paragraph", "First paragraph of text"), ("paragraph", "Second paragraph of text more"),
    ]
    assert h.extract("")["blocks"] == [] and h.extract("")["title"] is None


@pytest.mark.parametrize(("stale", "coverage", "errors", "blocked"), [(0, 0.1, 3, False), (2, 0.9, 0, False), (2, 0.5, 0, True), (2, 0.9, 1, True)])
def test_prune_guard(spark, stale, coverage, errors, blocked):
    assert _one(spark, crawl.prune_blocked(F.lit(stale), F.lit(coverage), F.lit(0.7), F.lit(errors))) is blocked


def test_walk_keeps_first_in_first_out_order_and_budget(spark):
    links = spark.createDataFrame([(1, "/", "/b", 0), (1, "/", "/a", 1), (1, "/b", "/c", 0), (1, "/a", "/d", 0), (1, "/c", "/", 0), (1, "/d", "/e", 0)], "site_id int, url string, target string, position int")
    start = spark.createDataFrame([(1, "/")], "site_id int, url string")
    order = [r.url for r in crawl.walk(start, links, 5, tables.saved).orderBy("rank").collect()]
    assert order == ["/", "/b", "/a", "/c", "/d"]


def test_walk_follows_a_chain_of_any_depth(spark):
    links = spark.createDataFrame([(1, f"/{i}", f"/{i + 1}", 0) for i in range(60)], "site_id int, url string, target string, position int")
    start = spark.createDataFrame([(1, "/0")], "site_id int, url string")
    for maximum, n in ((5000, 61), (53, 53)):
        rows = crawl.walk(start, links.coalesce(1), maximum, tables.saved).orderBy("rank").collect()
        assert [(r.url, r.level, r["rank"]) for r in rows] == [(f"/{i}", i, i + 1) for i in range(n)]


def test_jobs(spark):
    table = spark.createDataFrame([(1, 1, "crawl", "queued", None), (2, 1, "crawl", "completed", None), (3, 2, "audit", "running", None)], "id long, site_id long, job_type string, status string, error string")
    assert {(r.site_id, r.id) for r in jobs.active(table).collect()} == {(1, 1), (2, 3)}
    assert {r.id: r.status for r in jobs.recovered(table).collect()} == {1: "error", 2: "completed", 3: "error"}
    asked = spark.createDataFrame([(1, "crawl"), (1, "audit"), (1, "audit")], "site_id long, job_type string")
    assert [(r.site_id, r.job_type) for r in jobs.created(table, asked).collect()] == [(1, "audit")]


def test_patch_tells_unset_from_null(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "site_id int, name string, domain string")
    updates = spark.createDataFrame([(1, None, None, ["domain"])], "site_id int, name string, domain string, set_fields array<string>")
    assert {tuple(r) for r in crawl.patched(base, updates, "site_id", ["name", "domain"]).collect()} == {(1, "a", None), (2, "b", "y")}


def test_stream_writes_each_block_once(spark, tmp_path):
    page = "<!doctype html><title>T</title><p>the very same paragraph</p>"
    schema = "page_id long, site_id long, url string, html string"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for i in range(2):
        spark.createDataFrame([(i, 1, f"/{i}", page + f"<p>paragraph number {i}</p>")], schema).write.mode("append").parquet(source)
        ingest(spark, source, target, state).awaitTermination(120)
    rows = spark.read.parquet(target).collect()
    assert sorted(r.original_content for r in rows) == ["T", "paragraph number 0", "paragraph number 1", "the very same paragraph"]


class _Answer:
    def __init__(self, status, headers, body=b""):
        self.status, self.headers, self.body = status, headers, body

    def getheader(self, name):
        return self.headers.get(name)

    def read(self, n):
        return self.body[:n]


def test_fetch_checks_every_hop():
    answers = []

    class Connection:
        def __init__(self, name, port, timeout):
            pass

        def request(self, *a, **k):
            pass

        def getresponse(self):
            return answers.pop(0)

        def close(self):
            pass

    def get(*a):
        answers[:] = a
        return http.fetch("https://a.com/", {"a.com"}, public=lambda *x: True, connect=Connection)

    assert get(_Answer(301, {"Location": "/b"}), _Answer(200, {"Content-Type": "text/html"}, b"x")) == ("https://a.com/b", 200, "text/html", b"x")
    with pytest.raises(http.UnsafeUrl):
        get(_Answer(302, {"Location": "http://169.254.169.254/"}))
    with pytest.raises(ValueError, match="too many"):
        get(*[_Answer(302, {"Location": "/"})] * 7)
    with pytest.raises(ValueError, match="large"):
        get(_Answer(200, {}, b"x" * (5 * 2**20 + 1)))
    assert not u.is_public_address("10.0.0.1") and u.is_public_address("8.8.8.8")


def test_short_lines_are_judged_by_the_rule_alone(spark, tmp_path):
    """A heading of five characters survives; a paragraph of five doesn't; both are lines of their page."""
    text = "Intro\nShort\nA paragraph of enough characters\n\nEnds."
    spark.createDataFrame([(1, text, "en", "s1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = site_queries.block_length_filter(spark, str(tmp_path)).first()
    assert (kept.doc_id, kept.n) == (1, 3)  # headings "Intro" and "Ends." need two characters, and the paragraph
    assert similarity_queries.page_hash_lists(spark, str(tmp_path)).first().n_hashes == 5
    assert [r.line for r in site_queries.block_keep_first(spark, str(tmp_path)).orderBy("line").collect()] == [0, 1, 2, 3, 4]


def _as_by_sql(spark, tmp_path, name, rows):
    """The query's rows and its SQL's over a table of pages (page_id, url, html)."""
    import duckdb

    import __spark_entry__

    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_titles_keep_what_their_sql_keeps(spark, tmp_path):
    titles = ["a&amp;&amp", "token = &quot;7f", "&amp;lt;", " \t a\x0bb  ", "a\nb", "\u3000x\u00a0", "\x85 y", "", "$1 \\"]
    pages = [f"<title>{x}</title><p>text</p>" for x in titles] + ["<TITLE>x</TITLE>", "no title", None]
    got, want = _as_by_sql(spark, tmp_path, "page_titles", [(i, f"http://a/{i}", x) for i, x in enumerate(pages)])
    assert got == want
    assert got[0] == (0, "a&&amp")


def test_upsert_pairs_repeated_urls_as_its_sql(spark, tmp_path):
    # stored and fetched both hold pages 11, 31, 41 of site 1 under one URL; page 21 was only fetched, page 5 only stored
    rows = [(11, "u", "a"), (31, "u", "b"), (41, "u", "c"), (21, "v", "d"), (5, "w", "e"), (1, None, "f"), (61, "x", "g"), (71, "x", None)]
    got, want = _as_by_sql(spark, tmp_path, "page_upsert", rows)
    assert got == want
    assert len([r for r in got if r[1] == "u"]) == 9
