from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from textquarry.llm import warc
from textquarry.llm.common import fresh_path

PAGES = "page_id long, url string, html string, digest int, payload int, first int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_and_lookup(spark):
    rows = [(5, "http://M.Example.com:80/a?b=1#x", "<p>é</p>"), (3, "https://m.example.com/a?b=1", "<p>é</p>"), (7, "http://example.com/ sp\nace", "other"), (8, None, None), (9, "http://z.org", ""), (None, "http://q.org/", "other"), (11, "http://x.org/", "big" * 300_000), (None, "http://lone.org/", "lone")]
    rows += [(100 + i, f"http://h{i % 7}.example.org/p{i}", f"page {i % 20}") for i in range(200)]
    pages = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], PAGES)
    folder = fresh_path(spark, "warc")
    directory = warc.write_index(warc.write_archives(pages, folder), folder, lines=16)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    want = sorted(((i, len((t or "").encode()), digest(t), "response" if first.get(t or "") == i else "revisit", None if first.get(t or "") == i else first[t or ""]) for i, _, t in rows), key=repr)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(directory, folder).collect()), key=repr)
    assert got == want
    for most in (0, 1 << 20):
        asked = pages.select("url").unionByName(spark.createDataFrame([("http://absent.example/",), ("http://z.org",)], "url string"))
        found = warc.find_records(directory, folder, asked, directory_bytes=most)
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()), key=repr) == want
        some = warc.find_records(directory, folder, spark.createDataFrame([("https://m.example.com/a?b=1",), ("http://absent.example/",)], "url string"), directory_bytes=most)
        assert sorted(r.page_id for r in some.collect()) == [3, 5]
    assert sorted(f.headers["X-Page-Id"] for f in warc.lookup(directory, folder, "http://m.example.com/a?b=1")) == ["3", "5"]
    for i in range(0, 200, 17):
        (one,) = warc.lookup(directory, folder, f"https://h{i % 7}.example.org/p{i}")
        assert one.headers["X-Page-Id"] == str(100 + i)
    assert warc.lookup(directory, folder, "http://absent.example/") == []


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (3, "http://c/", "long enough"), (4, "http://d/", "long enough")], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    rows = warc.write_archives(pages, folder, least_revisit=5).collect()
    assert {r.page_id: r.record_type for r in rows} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_no_pages(spark):
    directory, folder = warc.archived(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(directory, folder).count() == 0
    assert warc.find_records(directory, folder, spark.createDataFrame([("http://a/",)], "url string")).count() == 0
    assert warc.lookup(directory, folder, "http://a/") == []


def test_record_is_one_gzip_member():
    raw = warc.record(1, "http://a/", b"abc", "D", True, 1)
    assert gzip.decompress(raw).endswith(b"\r\n\r\nabc\r\n\r\n")
    head, payload = warc.parsed(raw)
    assert (head["WARC-Type"], payload) == ("response", b"abc")
    assert warc.url_key("HTTP://User@WWW.a.Com:8080/x y?q#f") == "com,a,www:8080)/x%20y?q"


def test_text_ids_and_equal_addresses(spark):
    """Ids of any type come back; rows equal in id and URL are ordered by their payload."""
    rows = [("p 1", "http://a.example/x", "one"), ("p 1", "http://a.example/x", "two"), ("q/2", "http://a.example/x", "one"), (None, None, "three")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    directory, folder = warc.archived(spark, df.repartition(2))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(directory, folder, "string").collect()), key=repr)
    assert got == sorted([("p 1", "response", None, 3), ("p 1", "response", None, 3), ("q/2", "revisit", "p 1", 3), (None, "response", None, 5)], key=repr)


def test_archives_go_only_where_executors_can_open_them(spark, tmp_path):
    assert warc.openable("file:///x/y") == "file:///x/y"
    assert warc.openable("s3a://bucket/x") == "s3://bucket/x"
    for folder in ("/x/y", "o3fs://volume/x", "file:/x"):
        with pytest.raises(ValueError, match="archives"):
            warc.openable(folder)
    # a bare path is qualified before it is used
    assert warc.openable(fresh_path(spark, "warc")).startswith("file:///")


def test_one_address_over_many_blocks(spark):
    pages = spark.createDataFrame([(i, "http://same.org/" if i % 3 else f"http://other.org/{i}", f"text {i}") for i in range(300)], "page_id long, url string, html string")
    folder = fresh_path(spark, "warc")
    directory = warc.write_index(warc.write_archives(pages, folder), folder, lines=8)
    found = warc.find_records(directory, folder, pages.select("url"))
    assert sorted(r.page_id for r in found.collect()) == list(range(300))
