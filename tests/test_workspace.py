"""Site-wise tables, stored vectors, postings, hash counts, the crawl's accounts, background jobs, the vector index."""

from __future__ import annotations

import glob
import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textquarry.engine import Engine
from textquarry.operators import crawl, embedding, postings
from textquarry.operators.vector_index import VectorIndex, recall
from textquarry.sources import http, tables

PAGES = "url string, html string, http_status int, content_type string, rank long, error string"
LINKS = "url string, reason string"


def page(*paragraphs):
    return "<!doctype html>" + "".join(f"<p>{p}</p>" for p in paragraphs)


def fetched(spark, *rows):
    """(url, html or None, rank, error)"""
    return spark.createDataFrame([(u, h, 200 if h else None, "text/html" if h else None, r, e) for u, h, r, e in rows], PAGES)


def times(root, site):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{root}/*/site_id={site}/**/*.parquet", recursive=True)}


A, B, C = "The first paragraph speaks of granite bridges", "Another one tells 100% of sailing_boats and nets", "A third has nothing to do with either"


@pytest.fixture(scope="module")
def two_sites(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("two"))
    e = Engine(spark, f"file://{root}")
    one, two = e.create_site("One", "one.example"), e.create_site("Two", "two.example")
    e.crawl(one, fetched(spark, ("https://one.example/", page(A, B), 1, None)))
    e.crawl(two, fetched(spark, ("https://two.example/", page(B, C), 1, None)))
    return e, root, one, two


def test_a_crawl_leaves_other_sites_files_alone(spark, two_sites):
    e, root, one, two = two_sites
    before, mine = times(root, two), times(root, one)
    assert before and mine
    e.crawl(one, fetched(spark, ("https://one.example/", page(A, B, "One more paragraph of this page"), 1, None)))
    assert times(root, two) == before and set(times(root, one)) > set(mine)
    e.reindex(one)
    e.store.tidy(1)
    assert times(root, two) == before and len(times(root, one)) < len(mine) * 3
    assert e.table("content_blocks", one).count() == 3 and e.table("content_blocks").count() == 5
    with pytest.raises(ValueError, match="site by site"):
        e.store.write("pages", e.table("pages"))


def test_a_check_uses_stored_vectors(spark, two_sites):
    """Stored vectors are swapped between two blocks: the check must follow them, and a reindex sets them right."""
    e, _, one, two = two_sites
    right = {r.original_content: r.embedding for r in e.table("content_blocks", two).collect()}
    assert right[C] == embedding._vectors([F_normal(C)], e.cfg.dimension)[0].tolist()
    df = e.table("content_blocks", two)
    e.store.write("content_blocks", df.withColumn("embedding", F.when(F.col("original_content") == C, F.array(*map(F.lit, right[B]))).otherwise(F.col("embedding"))), two)
    near = f"{B} and more"
    scores = {(r.site_id, r.original_content): r.semantic for r in e.check(near, persist=False)}
    wrong = {r.original_content: r for r in similar(e, spark, near)}
    assert wrong[C].semantic == wrong[B].semantic > 0.9 and scores[two, B] == wrong[B].semantic
    assert e.reindex(two, outdated_only=True)["reindexed_blocks"] == 0  # the signature is current: nothing to do
    assert e.reindex(two)["reindexed_blocks"] == 2
    assert {r.original_content: r.embedding for r in e.table("content_blocks", two).collect()} == right
    df = e.table("content_blocks", two)
    e.store.write("content_blocks", df.withColumn("embedding_version", F.when(F.col("original_content") == C, "old").otherwise(F.col("embedding_version"))), two)
    assert e.reindex(two, outdated_only=True)["reindexed_blocks"] == 1


def F_normal(text):
    from textquarry.functions.html import normal

    return normal(text)


def similar(e, spark, text):
    from textquarry.operators import similarity

    q = similarity.prepare(spark.createDataFrame([(0, None, text)], "query_id long, site_id long, original_content string"))
    b = similarity.prepare(e._baseline())
    return similarity.semantic_candidates(q, b, e.cfg).join(b.select("id", "original_content"), "id").collect()


def test_keyword_search_reads_candidates_and_equals_ilike(spark, two_sites):
    e, _, one, _ = two_sites
    rows = e.table("content_blocks").collect()
    rnd = random.Random(5)
    words = ["granite", "GRANITE bri", "100\\%", "sailing\\_boats", "g_anite", "para%of", "p%h", "zz", "%", "an", "xyzxyz", "a\\"]
    for text in (A, B, C):
        for _ in range(4):
            i = rnd.randrange(len(text) - 8)
            words.append(text[i : i + rnd.randrange(3, 8)].replace("%", "\\%"))
    for word in words:
        like = f"%{word.strip()}%"
        try:
            expected = {r.id for r in spark.createDataFrame([(r.id, r.original_content) for r in rows], "id long, t string").filter(F.col("t").ilike(like)).collect()}
        except Exception:
            continue  # a lone escape is no pattern
        assert {r.id for r in e.content(word, size=100)[2].collect()} == expected, word
    near = postings.candidates(e.table("postings"), "%granite%")
    assert near.count() == 1 and near.first().site_id == one
    assert postings.literals("ab%cde_fgh\\%x%") == ["cde", "fgh%x"] and postings.candidates(e.table("postings"), "%ab%") is None


def test_hash_counts_equal_a_recount_after_random_crawls(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    site = e.create_site("S", "s.example", min_crawl_coverage=0.1)
    rnd = random.Random(8)
    texts = [f"paragraph number {i} of a text that pages share" for i in range(6)]
    for _ in range(4):
        chosen = rnd.sample(range(4), rnd.randrange(1, 5))
        e.crawl(site, fetched(spark, *[(f"https://s.example/p{p}", page(*rnd.sample(texts, 3)), r, None) for r, p in enumerate(chosen, 1)]))
        stored = Counter(r.content_hash for r in e.table("content_blocks", site).collect())
        assert {r.content_hash: r.n for r in e.table("hash_counts", site).collect()} == stored
        assert max(stored.values()) == 1
        assert {r.id for r in e.table("postings", site).select("id").distinct().collect()} == {r.id for r in e.table("content_blocks", site).collect()}


def test_accounts_of_a_walk(spark, tmp_path):
    """Two requests end at one page, one times out; the first visited page owns a repeated block; links count as found."""
    e = Engine(spark, f"file://{tmp_path}")
    site = e.create_site("S", "s.example", crawler_max_pages=3)
    rows = fetched(
        spark, ("https://s.example/zebra", page(A), 1, None), ("https://s.example/about", page(A, B), 2, None), ("https://s.example/about", page(C), 3, None),
        ("https://s.example/slow", None, 4, "timed out after 15 s"), ("https://s.example/late", page(C), 5, None), ("https://s.example/cut", page("Beyond the budget of this site"), 6, None),
    )
    links = spark.createDataFrame([("https://s.example/zebra", None), ("https://s.example/private", "excluded"), ("https://s.example/private", "excluded"), ("https://s.example/about", None)], LINKS)
    got = e.crawl(site, rows, links)
    assert (got["pages_discovered"], got["pages_crawled"], got["pages_skipped"]) == (4, 3, 1)
    assert got["errors"] == ["https://s.example/slow: timed out after 15 s"]
    assert {r.original_content: r.url.rsplit("/", 1)[1] for r in e.table("content_blocks", site).collect()} == {A: "zebra", B: "about", C: "late"}
    report = e.preview_report(site, rows, links)
    assert report["urls_to_crawl"] == [f"https://s.example/{x}" for x in ("zebra", "about", "late", "cut")]
    assert report["skipped"] == [{"url": "https://s.example/private", "reason": "excluded"}] and report["errors"] == got["errors"]


def test_two_sites_are_walked_in_one_loop(spark, tmp_path):
    """Each site keeps its order, budget, policy and delay; the hosts are fetched side by side."""
    e = Engine(spark, f"file://{tmp_path}/ws")
    delay = 400
    one = e.create_site("One", "one.example", crawler_max_pages=4, request_delay_ms=delay, exclude_patterns=["/private"])
    two = e.create_site("Two", "two.example", crawler_max_pages=3, request_delay_ms=delay)
    to = lambda *links: "<!doctype html>" + "".join(f'<a href="{x}">x</a>' for x in links) + "<p>some words of this page</p>"
    web = {
        "https://one.example/": to("/b", "/a", "/private/x", "https://two.example/"), "https://one.example/a": to("/late"), "https://one.example/b": to("/", "/later"),
        "https://one.example/late": to(), "https://one.example/later": to(), "https://two.example/": to("/gone", "/c", "/d"), "https://two.example/c": to("/e"),
    }
    log = str(tmp_path / "log")

    def get(url, domains):
        with open(log, "a") as out:
            out.write(f"{time.time()} {url}\n")
        if url not in web:
            raise TimeoutError("timed out")
        return url, 200, "text/html", web[url].encode()

    pages, links = e.fetched_many([one, two], lambda front: http.polite(front, get, 4))
    visits = {s: [r.asked.split("example")[1] for r in pages.filter(F.col("site_id") == s).orderBy("rank").collect()] for s in (one, two)}
    assert visits[one][:1] == ["/"] and set(visits[one][1:3]) == {"/a", "/b"} and len(visits[one]) == 4
    assert visits[two][0] == "/" and len(visits[two]) == 3
    alone, _ = crawl.live_walk("https://one.example/", "one.example", lambda urls: http.polite(spark.createDataFrame([(1, x, i, "one.example", 0) for i, x in enumerate(urls)], "site_id long, url string, rank long, domain string, delay_ms int"), get, 1).drop("site_id", "rank"), 4, lambda url: F.when(url.contains("/private"), "excluded"), tables.saved)
    assert [r.asked for r in alone.orderBy("rank").collect()] == [f"https://one.example{x}" for x in visits[one]]
    assert [r.reason is not None for r in links.filter("url like '%private%'").collect()] == [True]
    stamps = [line.split() for line in open(log)][:7]
    for host in ("one.example", "two.example"):
        mine = [float(t) for t, url in stamps if host in url]
        # levels are separate rounds; within one the host's delay holds
        assert all(b - a >= delay / 1000 - 0.01 for a, b in zip(mine, mine[1:], strict=False)), mine
    got = e.crawl(two, pages.filter(F.col("site_id") == two).drop("site_id"), links.filter(F.col("site_id") == two).drop("site_id"))
    assert got["errors"] and all("timed out" in x for x in got["errors"])


def test_jobs_run_in_the_background(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    site = e.create_site("S", "s.example")

    def slow(seconds):
        def run(parts):
            for part in parts:
                time.sleep(seconds)
                yield part

        return lambda: spark.range(0, 16, 1, 16).mapInPandas(run, "id long").count()

    job, new = e.submit(site, "audit", slow(0.5))
    assert new and e.submit(site, "audit", slow(0)) == (job, False)
    seen = []
    while (row := e.job(job)).status == "running":
        seen.append(row.progress)
    assert seen == sorted(seen) and seen[0] < 100 and any(5 < p < 100 for p in seen)
    assert e.running.result(job) == 16 and (e.job(job).status, e.job(job).progress, e.job(job).result) == ("completed", 100, "16")
    job, _ = e.submit(site, "audit", slow(60))
    time.sleep(2)
    e.cancel(job)
    with pytest.raises(Exception):  # noqa: B017
        e.running.result(job, 30)
    assert (e.job(job).status, e.job(job).error) == ("error", "cancelled")
    e.crawl(site, fetched(spark, ("https://s.example/", page(A), 1, None)))
    job, _ = e.reindex_job(site)
    assert e.running.result(job, 120)["reindexed_blocks"] == 1 and '"reindexed_blocks": 1' in e.job(job).result


def test_vector_index_recall(spark, tmp_path):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
    texts = [(i, i % 7, "".join(rnd.choice(words[(i % 8) * 10 : (i % 8) * 10 + 12]) for _ in range(30))) for i in range(1200)]
    rows = spark.createDataFrame(texts, "id long, site_id long, text string").withColumn("embedding", embedding.vector(F.col("text"), 64))
    rows = rows.unionByName(spark.createDataFrame([(5000, 1, "", None), (5001, 1, "", [0.0] * 64)], rows.schema))
    queries = rows.filter("id % 50 = 0 and id < 5000").select(F.col("id").alias("query_id"), "site_id", "text", "embedding")
    index = VectorIndex.build(rows, f"file://{tmp_path}/index")
    assert spark.read.parquet(f"file://{tmp_path}/index/lists").count() == 1201  # every vector is listed
    exact = embedding.top_cosine(queries, rows, 200, dimension=64)
    near = VectorIndex.opened(spark, index.folder).search(queries, 200)
    assert recall(near, exact) >= 0.9
    whole = index.search(queries, 200, probes=len(index.centroids))
    assert recall(whole, exact) == 1.0 and whole.count() == exact.count()
    assert near.join(rows.select("id", F.col("site_id").alias("s")), "id").join(queries.select("query_id", "site_id"), "query_id").filter("s = site_id").isEmpty()
    assert VectorIndex.build(rows.limit(0), f"file://{tmp_path}/none").search(queries.limit(0), 5).collect() == []


def test_a_check_with_the_index(two_sites):
    e, *_ = two_sites
    e.reindex(1)
    index = e.build_index()
    assert [r.original_content for r in e.check(A, persist=False, index=e.index())][:1] == [A] and len(index.centroids) >= 1
