"""Live pages as a Spark data source: one row a URL, redirects followed by hand, every hop checked.

    spark.dataSource.register(HttpPages)
    spark.read.format("pages").option("urls", "https://a.example/\\nhttps://a.example/b").option("domains", "a.example").load()
"""

from __future__ import annotations

import http.client
import time
from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textquarry.functions.urls import _canonical, resolves_publicly

MOST_REQUESTS, MOST_BYTES = 6, 5 << 20
REDIRECTS = {301, 302, 303, 307, 308}
SCHEMA = "url string, final_url string, http_status int, content_type string, html string, error string"


class UnsafeUrl(ValueError):
    """A URL that must not be fetched."""


def checked(url: str, domains: set[str]) -> tuple[str, int]:
    """Host and port of a URL that may be fetched."""
    cut = urlsplit(url)
    if cut.scheme not in ("http", "https"):
        raise UnsafeUrl("scheme")
    if not cut.hostname or cut.username or cut.password:
        raise UnsafeUrl("format")
    name = _canonical(cut.hostname)
    if not any(name == d or name.endswith(f".{d}") for d in map(_canonical, domains)):
        raise UnsafeUrl("host")
    port = cut.port or (443 if cut.scheme == "https" else 80)
    if port not in (80, 443):
        raise UnsafeUrl("port")
    return cut.hostname, port


def fetch(url: str, domains: set[str], timeout: float = 15, public=resolves_publicly, connect=None) -> tuple[str, int, str, bytes]:
    """Final URL, status, content type and body."""
    for _ in range(MOST_REQUESTS):
        name, port = checked(url, domains)
        if not public(name, port):
            raise UnsafeUrl("address")
        cut = urlsplit(url)
        made = (connect or (http.client.HTTPSConnection if cut.scheme == "https" else http.client.HTTPConnection))(name, port, timeout=timeout)
        try:
            made.request("GET", (cut.path or "/") + (f"?{cut.query}" if cut.query else ""), headers={"Host": name, "User-Agent": "textquarry"})
            answer = made.getresponse()
            if answer.status in REDIRECTS:
                if not (target := answer.getheader("Location")):
                    raise ValueError("redirect without a location")
                url = urljoin(url, target)
                continue
            body = answer.read(MOST_BYTES + 1)
            if len(body) > MOST_BYTES:
                raise ValueError("response too large")
            return url, answer.status, answer.getheader("Content-Type") or "", body
        finally:
            made.close()
    raise ValueError("too many redirects")


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        super().__init__(urls)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.domains = {d for d in options.get("domains", "").split(",") if d.strip()}
        self.delay = int(options.get("delay_ms", "0"))

    def partitions(self) -> list[InputPartition]:
        """One a URL; with a delay between a site's requests one for all."""
        return [_Urls(self.urls)] if self.delay else [_Urls([u]) for u in self.urls]

    def read(self, partition: _Urls) -> Iterator[tuple]:
        for i, url in enumerate(partition.urls):
            if i and self.delay:
                time.sleep(self.delay / 1000)
            try:
                final, status, kind, body = fetch(url, self.domains)
                yield url, final, status, kind, body.decode("utf-8", "replace"), None
            except Exception as fault:  # noqa: BLE001  one bad page must not end the read
                yield url, None, None, None, None, str(fault)[:180]


class HttpPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


FETCHED = "site_id long, url string, rank long, final_url string, http_status int, content_type string, html string, error string"


def polite(front: DataFrame, get: Callable[[str, set[str]], tuple[str, int, str, bytes]] = fetch, tasks: int = 64) -> DataFrame:
    """Fetches a frontier (site_id, url, rank, domain, delay_ms): hosts side by side, a host's pages in one task, by rank and
    with its own delay between two requests. While one host waits, the task's others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[str, float] = {}
        for batch in batches:
            waiting: dict[str, list] = {}
            for row in batch.sort_values(["rank", "site_id"]).itertuples(index=False):
                waiting.setdefault(row.domain, []).append(row)
            while waiting:
                host = min(waiting, key=lambda x: ready.get(x, 0.0))
                row = waiting[host].pop(0)
                if not waiting[host]:
                    del waiting[host]
                time.sleep(max(0.0, ready.get(host, 0.0) - time.time()))
                try:
                    final, status, kind, body = get(row.url, {host})
                    out = (row.site_id, row.url, row.rank, final, status, kind, body.decode("utf-8", "replace"), None)
                except Exception as fault:  # noqa: BLE001  one bad page must not end the level
                    out = (row.site_id, row.url, row.rank, None, None, None, None, str(fault)[:180])
                ready[host] = time.time() + (row.delay_ms or 0) / 1000
                yield pd.DataFrame([out], columns=[x.split()[0] for x in FETCHED.split(", ")]).astype({"http_status": "Int32"})

    dealt = front.select("site_id", "url", "rank", "domain", "delay_ms").repartition(tasks, "domain")
    return dealt.mapInPandas(run, FETCHED)
