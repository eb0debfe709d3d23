"""The engine's operations, end to end, on a small workspace."""

from __future__ import annotations

import pytest

from textquarry.engine import Engine, Invalid

PAGES = "url string, html string, http_status int, content_type string"


def page(*paragraphs, title="T"):
    return f"<!doctype html><title>{title}</title>" + "".join(f"<p>{p}</p>" for p in paragraphs)


COPY = "We develop custom synthesis routes for pharmaceutical research partners"


def test_life_of_two_sites(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/ws")
    base = e.create_site("Base", "https://www.Base.example/", exclude_patterns=["/private/"])
    own = e.create_site("Own", "own.example", site_type="candidate")
    with pytest.raises(Invalid):
        e.create_site("Again", "www.base.example")
    for wrong in ({"status": "x"}, {"crawler_max_pages": 0}, {"include_patterns": ["("]}, {"allowed_query_params": ["a b"]}):
        with pytest.raises(Invalid):
            e.patch_site(base, **wrong)

    fetched = spark.createDataFrame(
        [("https://www.base.example/", page(COPY, "Second paragraph of the homepage"), 200, "text/html"), ("https://www.base.example/about", page(COPY, "About our long history"), 200, None), ("https://www.base.example/private/x", page("hidden page of text"), 200, "text/html"), ("https://www.base.example/product/1", page("a product page text"), 200, "text/html"), ("https://www.base.example/f", "%PDF", 200, "application/pdf")],
        PAGES,
    )
    assert {r.url.rsplit("/", 1)[1]: r.action for r in e.preview(base, fetched).collect()} == {"": "crawl", "about": "crawl", "x": "skip", "1": "skip", "f": "error"}
    first = e.crawl(base, fetched)
    assert (first["pages_crawled"], first["pages_skipped"], len(first["errors"]), first["blocks"]) == (2, 2, 1, 4)  # equal blocks of a site count once
    e.crawl(own, spark.createDataFrame([("https://own.example/", page(COPY, "Entirely different words stand here"), 200, "text/html")], PAGES))
    assert e.stats() == {"sites": 2, "pages": 3, "content_blocks": 7, "similarity_checks": 0}

    found = e.check(COPY)
    assert [(r.site_name, r.overall, r.exact_match) for r in found][:1] == [("Base", 1.0, True)]
    assert found[0].highlight_segments == [(COPY, True)]
    assert e.stats()["similarity_checks"] == 1 and e.table("similarity_checks").first().results[0].risk_level == "high"
    summary, findings = e.audit(own)
    assert (summary["total_blocks"], summary["matched_blocks"], summary["high_risk_blocks"]) == (3, 2, 2) and findings.count() == 2  # the title T is a block of both

    # a second crawl: one page is gone, but the errors keep it; without errors it is pruned
    gone = fetched.filter("url not like '%about'")
    assert e.crawl(base, gone)["prune_blocked"] and e.table("pages").filter(f"site_id = {base}").count() == 2
    e.patch_site(base, min_crawl_coverage=0.5, name="Renamed")
    again = e.crawl(base, gone.filter("url not like '%/f'"))
    assert not again["prune_blocked"] and again["stale_pages"] == 1 and again["blocks"] == 3
    assert [r.status for r in e.crawl_runs(base).collect()] == ["completed", "completed_with_warnings", "completed_with_warnings"]
    assert {r.name: (r.page_count, r.block_count, r.outdated_count) for r in e.sites().collect()} == {"Renamed": (1, 3, 0), "Own": (1, 3, 0)}

    total, pages, rows = e.content("CUSTOM%routes", size=1)
    assert (total, pages, rows.count()) == (2, 2, 1)
    assert e.block(1).original_content and e.reindex(own)["reindexed_blocks"] == 3
    job, _ = e.run_job(own, "reindex", lambda: e.reindex(own))
    assert e.job(job).status == "completed"
    with pytest.raises(ZeroDivisionError):
        e.run_job(own, "audit", lambda: 1 / 0)
    e.delete_site(base)
    assert e.stats() == {"sites": 1, "pages": 1, "content_blocks": 3, "similarity_checks": 1}


def test_live_walk_of_a_site(spark, tmp_path):
    """A cycle, a redirect, a whitelist, policy, a fault and a budget that cuts."""
    e = Engine(spark, f"file://{tmp_path}/walk")
    site = e.create_site("S", "s.example", exclude_patterns=["/private"], allowed_query_params=["page"], crawler_max_pages=6)
    to = lambda *hrefs: "<!doctype html>" + "".join(f'<a href="{x}">x</a>' for x in hrefs) + "<p>some words of a page</p>"
    web = {
        "https://s.example/": to("/b", "/about", "/private/x", "/list?page=2&utm=1", "https://other.example/"),
        "https://s.example/about": to("/", "/old"), "https://s.example/b": to("/", "/late"), "https://s.example/list?page=2": to("/list?page=2"),
        "https://s.example/old": to("/new2"), "https://s.example/late": to("/never"),
    }
    calls = []

    def fetch(urls):
        calls.append(urls)
        final = {"https://s.example/old": "https://s.example/moved"}
        rows = [(x, final.get(x, x), 200, "text/html", web[x], None) if x in web else (x, None, None, None, None, "gone") for x in urls]
        return spark.createDataFrame(rows, "url string, final_url string, http_status int, content_type string, html string, error string")

    pages, links = e.fetched(site, fetch)
    assert calls == [["https://s.example/"], ["https://s.example/about", "https://s.example/b", "https://s.example/list?page=2"], ["https://s.example/old", "https://s.example/late"]]
    rows = {r.url: r for r in pages.collect()}
    assert len(rows) == 6 and rows["https://s.example/moved"].asked == "https://s.example/old" and all(r.error is None for r in rows.values())
    assert [r.url for r in e.skipped(links)] == ["https://s.example/private/x"]
    assert e.crawl(site, pages)["pages_crawled"] == 6
