"""The engine's operations over a folder of table snapshots: sites, crawls, jobs, stored content, checks, audits.

Tables are series of versions (sources.workspace); pages, blocks, their 3-gram postings and the counts of their hashes lie
site by site, so a crawl reads and writes its own site only. Blocks keep their vectors; a check embeds its text alone. Crawls take fetched pages as a DataFrame (url, html, http_status, content_type): a stored crawl,
or the live source in sources.http.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry import schema
from textquarry.functions import html as h
from textquarry.functions import text as t
from textquarry.functions import urls as u
from textquarry.operators import crawl, embedding, jobs, postings, similarity
from textquarry.operators.vector_index import VectorIndex
from textquarry.running import Running
from textquarry.session import steady
from textquarry.settings import DEFAULT, Settings
from textquarry.sources import tables
from textquarry.sources.http import HttpPages, polite
from textquarry.sources.sinks import check_rows
from textquarry.sources.workspace import Workspace

TABLES = {"sites": schema.SITES, "pages": schema.PAGES, "content_blocks": schema.CONTENT_BLOCKS, "postings": schema.POSTINGS, "hash_counts": schema.HASH_COUNTS, "similarity_checks": schema.SIMILARITY_CHECKS, "background_jobs": schema.BACKGROUND_JOBS, "crawl_runs": schema.CRAWL_RUNS}
#: Tables that a site's crawl rewrites for that site alone.
BY_SITE = {"pages", "content_blocks", "postings", "hash_counts"}
#: Candidate blocks of a keyword that are named to the scan; more are joined.
MOST_PUSHED = 5_000
MOST_ERRORS, MOST_LISTED = 30, 500


class Invalid(ValueError):
    """A request that breaks a rule."""


def _patterns(values: list[str]) -> list[str]:
    out = list(dict.fromkeys(v.strip() for v in values if v.strip()))
    if len(values) > 50 or any(len(v) > 300 for v in out):
        raise Invalid("patterns: at most 50 of at most 300 characters")
    for v in out:
        try:
            re.compile(v)
        except re.error as fault:
            raise Invalid(f"pattern {v}: {fault}") from fault
    return out


def _parameters(values: list[str]) -> list[str]:
    out = list(dict.fromkeys(v.strip() for v in values if v.strip()))
    if len(values) > 30 or any(not re.fullmatch(r"[A-Za-z0-9_.-]{1,80}", v) for v in out):
        raise Invalid("query parameters")
    return out


def validated(fields: dict) -> dict:
    """Site fields by the rules of the API; only those given."""
    out = dict(fields)
    for name, clean in (("include_patterns", _patterns), ("exclude_patterns", _patterns), ("allowed_query_params", _parameters)):
        if out.get(name) is not None:
            out[name] = clean(out[name])
    if "domain" in out:
        try:
            out["domain"] = u.registered_domain(out["domain"])
        except ValueError as fault:
            raise Invalid("domain") from fault
    for name in ("name", "sitemap_url"):
        if out.get(name) is not None:
            out[name] = out[name].strip()
    if "name" in out and not 1 <= len(out["name"] or "") <= 200:
        raise Invalid("name")
    if out.get("sitemap_url") and not re.match(r"https?://[^/@\s]+(?:/|$)", out["sitemap_url"]):
        raise Invalid("sitemap_url")
    for name, allowed in (("status", schema.SITE_STATUS), ("site_type", schema.SITE_TYPES)):
        if out.get(name) is not None and out[name] not in allowed:
            raise Invalid(name)
    for name, low, high in (("crawler_max_pages", 1, 5000), ("request_delay_ms", 0, 5000), ("min_crawl_coverage", 0.1, 1.0)):
        if out.get(name) is not None and not low <= out[name] <= high:
            raise Invalid(name)
    return out


class Engine:
    def __init__(self, spark: SparkSession, root: str, cfg: Settings = DEFAULT):
        self.spark, self.root, self.cfg = steady(spark), root.rstrip("/"), cfg
        self.store = Workspace(self.spark, self.root, TABLES, BY_SITE)
        self.running = Running(self.spark)

    # ------------------------------------------------------------ tables
    def table(self, name: str, site_id: int | None = None) -> DataFrame:
        return self.store.read(name, site_id)

    def _add(self, name: str, rows: list[dict]) -> list[int]:
        """Appends rows with new ids."""
        with self.store.lock:
            old = self.table(name)
            first = self._last_id(name) + 1
            full = [tuple({**r, "id": first + i}.get(f.name) for f in TABLES[name].fields) for i, r in enumerate(rows)]
            self.store.write(name, old.unionByName(self.spark.createDataFrame(full, TABLES[name])))
        return list(range(first, first + len(rows)))

    def _last_id(self, name: str) -> int:
        return self.table(name).agg(F.max("id")).first()[0] or 0

    def _change(self, name: str, key: int, **values: object) -> None:
        fields = {f.name: f.dataType for f in TABLES[name].fields}
        with self.store.lock:
            df = self.table(name)
            self.store.write(name, df.withColumns({c: F.when(F.col("id") == key, F.lit(v).cast(fields[c])).otherwise(F.col(c)) for c, v in values.items()}))

    def _site(self, site_id: int) -> Row:
        found = self.table("sites").filter(F.col("id") == site_id).first()
        if found is None:
            raise KeyError(site_id)
        return found

    # ------------------------------------------------------------ sites
    def health(self) -> dict:
        return {"status": "ok", "embedding_provider": self.cfg.signature.split(":")[0], "embedding_version": self.cfg.signature, "vector_database": "spark"}

    def stats(self) -> dict:
        return {k: self.table(n).count() for k, n in (("sites", "sites"), ("pages", "pages"), ("content_blocks", "content_blocks"), ("similarity_checks", "similarity_checks"))}

    def sites(self) -> DataFrame:
        """Sites with their counts, newest first."""
        pages = self.table("pages").groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("page_count"))
        blocks = self.table("content_blocks").groupBy(F.col("site_id").alias("id")).agg(F.count("*").alias("block_count"), F.count_if(F.col("embedding_version") != self.cfg.signature).alias("outdated_count"))
        out = self.table("sites").join(pages, "id", "left").join(blocks, "id", "left").na.fill(0, ["page_count", "block_count", "outdated_count"])
        return out.orderBy(F.desc("created_at"), F.desc("id"))

    def create_site(self, name: str, domain: str, **fields: object) -> int:
        row = {"sitemap_url": "", "status": "active", "site_type": "baseline", "include_patterns": [], "exclude_patterns": [], "allowed_query_params": [], "request_delay_ms": 0, "min_crawl_coverage": 0.7}
        row |= validated({"name": name, "domain": domain, **fields})
        if not self.table("sites").filter(F.col("domain") == row["domain"]).isEmpty():
            raise Invalid("this domain exists")
        now = datetime.now(UTC)
        return self._add("sites", [row | {"created_at": now, "updated_at": now}])[0]

    def patch_site(self, site_id: int, **fields: object) -> None:
        self._site(site_id)
        clean = validated(fields)
        kinds = {f.name: f.dataType for f in TABLES["sites"].fields}
        update = self.spark.createDataFrame([(site_id, *clean.values(), list(clean))], T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, kinds[c]) for c in clean), T.StructField("set_fields", T.ArrayType(T.StringType()))]))
        base = self.table("sites")
        rest = [c for c in base.columns if c != "id" and c not in clean]
        changed = crawl.patched(base.select("id", *clean), update, "id", list(clean)).join(base.select("id", *rest), "id")
        self.store.write("sites", changed.withColumn("updated_at", F.when(F.col("id") == site_id, F.current_timestamp()).otherwise(F.col("updated_at"))))

    def delete_site(self, site_id: int) -> None:
        """With its pages, blocks, jobs and runs; checks stay."""
        self._site(site_id)
        gone = self.spark.createDataFrame([(site_id,)], "site_id long")
        self.store.write("sites", self.table("sites").filter(F.col("id") != site_id))
        for name in sorted(BY_SITE):
            self.store.write(name, self.table(name, site_id).limit(0), site_id)
        for name in ("background_jobs", "crawl_runs"):
            self.store.write(name, crawl.without_site(self.table(name), gone))

    # ------------------------------------------------------------ jobs
    def create_job(self, site_id: int, kind: str) -> tuple[int, bool]:
        """An active job of the kind, or a new one."""
        found = jobs.active(self.table("background_jobs").filter((F.col("site_id") == site_id) & (F.col("job_type") == kind))).first()
        if found is not None:
            return found["id"], False
        return self._add("background_jobs", [{"site_id": site_id, "job_type": kind, "status": "queued", "progress": 0, "created_at": datetime.now(UTC)}])[0], True

    def job(self, job_id: int) -> Row | None:
        """The job's row; while it runs here, with the share of its Spark tasks that are done."""
        row = self.table("background_jobs").filter(F.col("id") == job_id).first()
        if row is None or row.status != "running":
            return row
        return Row(**{**row.asDict(), "progress": max(row.progress or 0, self.running.progress(job_id))})

    def run_job(self, site_id: int, kind: str, work: Callable[[], object]) -> tuple[int, object]:
        """Runs `work` under a job and waits: running, then completed, or error with at most 1000 characters of why."""
        job_id, _ = self.submit(site_id, kind, work)
        return job_id, self.running.result(job_id)

    def submit(self, site_id: int, kind: str, work: Callable[[], object]) -> tuple[int, bool]:
        """Starts `work` in the background under a new job, unless an active one of the kind exists: its id, and whether it is new."""
        with self.store.lock:
            job_id, new = self.create_job(site_id, kind)
            if not new:
                return job_id, False
            self._change("background_jobs", job_id, status="running", progress=5, started_at=datetime.now(UTC))

        def run() -> object:
            try:
                result = work()
            except Exception as fault:
                why = "cancelled" if self.running.cancelled(job_id) else str(fault)[:1000]
                self._change("background_jobs", job_id, status="error", error=why, finished_at=datetime.now(UTC))
                raise
            kept = json.dumps(result, default=str) if isinstance(result, (dict, list, str, int, float)) else None
            self._change("background_jobs", job_id, status="completed", progress=100, result=kept, finished_at=datetime.now(UTC))
            return result

        self.running.start(job_id, run)
        return job_id, True

    def cancel(self, job_id: int) -> None:
        """Stops a job that runs here; its row ends as an error, "cancelled"."""
        self.running.cancel(job_id)

    def crawl_job(self, site_id: int, fetched: DataFrame, links: DataFrame | None = None) -> tuple[int, bool]:
        return self.submit(site_id, "crawl", lambda: self.crawl(site_id, fetched, links))

    def preview_job(self, site_id: int, fetched: DataFrame, links: DataFrame | None = None) -> tuple[int, bool]:
        return self.submit(site_id, "preview", lambda: self.preview_report(site_id, fetched, links))

    def audit_job(self, site_id: int) -> tuple[int, bool]:
        return self.submit(site_id, "audit", lambda: self.audit(site_id)[0])

    def reindex_job(self, site_id: int) -> tuple[int, bool]:
        return self.submit(site_id, "reindex", lambda: self.reindex(site_id))

    def recover(self) -> None:
        """After a restart nothing is running any more."""
        self.store.write("background_jobs", jobs.recovered(self.table("background_jobs")))
        runs = self.table("crawl_runs")
        self.store.write("crawl_runs", runs.withColumn("status", F.when(F.col("status") == "running", "error").otherwise(F.col("status"))))

    def crawl_runs(self, site_id: int, limit: int = 10) -> DataFrame:
        return self.table("crawl_runs").filter(F.col("site_id") == site_id).orderBy(F.desc("id")).limit(max(1, min(limit, 50)))

    # ------------------------------------------------------------ crawl
    def _classified(self, site: Row, fetched: DataFrame) -> DataFrame:
        """Fetched pages of the site with `reason` (not to be crawled) or `error`."""
        home = f"https://{site.domain}/"
        empty = F.array().cast("array<string>")
        include = F.array(*map(F.lit, site.include_patterns)) if site.include_patterns else empty
        exclude = F.array(*map(F.lit, site.exclude_patterns)) if site.exclude_patterns else empty
        # a walk tells when a page was visited and why it failed; without, the homepage comes first, then by link priority
        visited = F.col("rank").cast("long") if "rank" in fetched.columns else F.lit(None).cast("long")
        failed = F.col("error") if "error" in fetched.columns else F.lit(None).cast("string")
        each = fetched.select("url", F.coalesce("html", F.lit("")).alias("html"), "http_status", F.coalesce("content_type", F.lit("")).alias("content_type"), visited.alias("visited"), failed.alias("failed"))
        order = [F.regexp_replace(u.path(F.col("url")), "/+$", "") != "", u.priority(F.col("url"))]
        first = F.struct(F.col("visited").isNull(), "visited", F.col("failed").isNotNull(), F.sha2("html", 256), "http_status", "content_type")
        # of several requests that end at one page the first visited counts
        rows = each.groupBy("url").agg(F.min_by(F.struct("html", "http_status", "content_type", "visited", "failed"), first).alias("r")).select("url", "r.*").withColumn("order", F.struct(F.col("visited").isNull(), "visited", *order, "url"))
        rows = rows.withColumn("fault", F.coalesce("failed", u.url_fault(F.col("url"), F.lit(site.domain)), F.when(~h.is_html(F.col("html"), F.col("content_type")), "not HTML")))
        rows = rows.withColumn("p", h.extract_page(F.col("html")))
        text = F.concat_ws(" ", "p.title", "p.meta_description", F.transform("p.blocks", lambda b: b["text"]))
        reason = F.coalesce(u.policy_reason(F.col("url"), include, exclude, F.lit(home)), F.when(u.is_product_page(F.col("url"), text), u.REASON_PAGE))
        return rows.withColumns({"error": F.coalesce("fault", "p.error"), "reason": reason})

    def fetched(self, site_id: int, fetch: Callable[[list[str]], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
        """Walks a site live, within its page budget and with its delay: pages for crawl() or preview(), and the links with
        why some weren't followed. `fetch` replaces the HTTP source."""
        site = self._site(site_id)

        def live(urls: list[str]) -> DataFrame:
            self.spark.dataSource.register(HttpPages)
            reader = self.spark.read.format("pages").option("urls", "\n".join(urls)).option("domains", site.domain)
            return reader.option("delay_ms", str(site.request_delay_ms or 0)).load()

        home = f"https://{site.domain}/"
        include, exclude, allowed = (F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (site.include_patterns, site.exclude_patterns, site.allowed_query_params))
        reason = lambda url: u.policy_reason(url, include, exclude, F.lit(home))
        pages, links = crawl.live_walk(home, site.domain, fetch or live, site.crawler_max_pages or self.cfg.crawler_max_pages, reason, tables.saved, allowed)
        return pages, links

    def fetched_many(self, site_ids: list[int], fetch: Callable[[DataFrame], DataFrame] = polite) -> tuple[DataFrame, DataFrame]:
        """Walks several sites at once, each within its own budget and with its own delay: pages and links with their site_id."""
        empty = F.array().cast("array<string>")
        patterns = {"include": "include_patterns", "exclude": "exclude_patterns", "allowed": "allowed_query_params"}
        mine = self.table("sites").filter(F.col("id").isin(site_ids))
        rules = mine.select(
            F.col("id").alias("site_id"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("home"), "domain", F.coalesce("crawler_max_pages", F.lit(self.cfg.crawler_max_pages)).alias("maximum"),
            F.coalesce("request_delay_ms", F.lit(0)).alias("delay_ms"), *[F.coalesce(column, empty).alias(name) for name, column in patterns.items()],
        )
        return crawl.live_walks(rules, fetch, tables.saved)

    def crawl_many(self, site_ids: list[int], fetch: Callable[[DataFrame], DataFrame] = polite) -> dict[int, dict]:
        """Walks the sites together, then stores each one's pages."""
        pages, links = self.fetched_many(site_ids, fetch)
        return {s: self.crawl(s, pages.filter(F.col("site_id") == s).drop("site_id"), links.filter(F.col("site_id") == s).drop("site_id")) for s in site_ids}

    def skipped(self, links: DataFrame) -> list[Row]:
        """The first MOST_LISTED links that weren't followed, with the reason."""
        return links.filter("reason is not null").orderBy("url").limit(MOST_LISTED).collect()

    def preview(self, site_id: int, fetched: DataFrame) -> DataFrame:
        """What a crawl would do with each page; nothing is written."""
        rows = self._classified(self._site(site_id), fetched)
        action = F.when(F.col("error").isNotNull(), "error").when(F.col("reason").isNotNull(), "skip").otherwise("crawl")
        return rows.select("url", action.alias("action"), "reason", "error", F.col("p.title").alias("title"), F.size("p.blocks").alias("blocks"))

    def preview_report(self, site_id: int, fetched: DataFrame, links: DataFrame | None = None) -> dict:
        """What a crawl would do, as lists of a bounded length; nothing is written."""
        site = self._site(site_id)
        rows = tables.saved(self._classified(site, fetched).select("url", "error", "reason", "order"))
        good = rows.filter("error is null and reason is null")
        skipped = self._skips(rows, links)
        errors = rows.filter("error is not null").orderBy("order").limit(MOST_ERRORS).collect()
        return {
            "site_id": site_id,
            "pages_discovered": self._discovered(site, rows, links),
            "pages_to_crawl": good.count(),
            "urls_to_crawl": [r.url for r in good.orderBy("order").limit(MOST_LISTED).collect()],
            "skipped": [{"url": r.url, "reason": r.reason} for r in skipped.orderBy("url").limit(MOST_LISTED).collect()],
            "errors": [f"{r.url}: {r.error[:180]}" for r in errors],
        }

    def _skips(self, rows: DataFrame, links: DataFrame | None) -> DataFrame:
        """(url, reason) of pages and links that policy leaves out, each URL once."""
        out = rows.filter("error is null and reason is not null").select("url", "reason")
        if links is not None:
            out = out.unionByName(links.filter("reason is not null").select("url", "reason"))
        return out.groupBy("url").agg(F.min("reason").alias("reason"))

    def _discovered(self, site: Row, rows: DataFrame, links: DataFrame | None) -> int:
        """The homepage and all links found, followed or not; without links, the pages."""
        found = rows.select("url") if links is None else links.select("url").unionByName(self.spark.createDataFrame([(f"https://{site.domain}/",)], "url string"))
        return found.distinct().count()

    def _embedded(self, blocks: DataFrame) -> DataFrame:
        """Blocks with the vector of their text by the current settings, and its signature."""
        core = t.chemical_core(F.col("original_content"))
        text = t.embedded_text(F.col("normalized_content"), core)
        return blocks.withColumns({"embedding": embedding.vector(text, self.cfg.dimension), "embedding_version": F.lit(self.cfg.signature)})

    def crawl(self, site_id: int, fetched: DataFrame, links: DataFrame | None = None) -> dict:
        """Stores the fetched pages of a site: unchanged ones are kept, changed ones replaced, stale ones pruned unless guarded.

        `fetched` may carry `rank` (the order of visits, which decides who owns a repeated block and what the page budget cuts) and
        `error`, `links` what the walk found, followed or not. Only the site's own tables are read and written.
        """
        site = self._site(site_id)
        if site.status == "paused":
            raise Invalid("the site is paused")
        limit = site.crawler_max_pages or self.cfg.crawler_max_pages
        rows = tables.saved(self._classified(site, fetched))
        # within the budget, so a window over them is one of a bounded number of pages
        within = rows.filter("error is null and reason is null").orderBy("order").limit(limit)
        good = tables.saved(within.withColumn("place", F.row_number().over(Window.orderBy("order"))))
        own, blocks = self.table("pages", site_id), self.table("content_blocks", site_id)
        pages = good.select(F.lit(site_id).cast("long").alias("site_id"), "url", F.col("p.title").alias("title"), F.col("p.meta_description").alias("meta_description"), "http_status", F.sha2("html", 256).alias("content_hash"), F.current_timestamp().alias("crawled_at"), "place")
        pages = pages.join(own.select("url", "id", F.col("content_hash").alias("old")), "url", "left")
        fresh_id = F.lit(self._last_id("pages")) + F.row_number().over(Window.orderBy(F.col("id").isNotNull(), "url"))
        pages = tables.saved(pages.withColumn("id", F.coalesce("id", fresh_id)).withColumn("changed", ~F.col("old").eqNullSafe(F.col("content_hash"))))
        errors = [f"{r.url}: {r.error[:180]}"[:300] for r in rows.filter("error is not null").orderBy("order").limit(MOST_ERRORS).collect()]
        retained = pages.select("site_id", "url")
        counts = {"pages_discovered": self._discovered(site, rows, links), "pages_crawled": pages.count(), "pages_skipped": self._skips(rows, links).count()}
        previous, gone = own.count(), crawl.stale(own, retained).count()
        reached = counts["pages_crawled"] / previous if previous else 1.0
        blocked = bool(gone and (errors or reached < site.min_crawl_coverage))
        prune = counts["pages_crawled"] > 0 and not blocked

        lost = crawl.stale(own, retained) if prune else own.limit(0)
        changed = pages.filter("changed").select("site_id", F.col("id").alias("page_id"), "url", "title", "place")
        replaced = changed.select("page_id").unionByName(lost.select(F.col("id").alias("page_id")))
        kept = blocks.join(replaced, "page_id", "left_anti")
        away = blocks.join(replaced, "page_id", "left_semi")
        each = changed.join(good.select("url", F.posexplode("p.blocks").alias("position", "b")), "url").select("site_id", "page_id", "url", F.col("title").alias("page_title"), "place", "position", "b.content_type", F.col("b.text").alias("original_content"))
        each = each.withColumn("normalized_content", t.normalized(F.col("original_content"))).withColumn("content_hash", t.hash_of(F.col("normalized_content")))
        # a hash counts for a page that keeps it, by the stored counts without those of pages that go, else for the first visited page
        counted = crawl.counted(self.table("hash_counts", site_id), away, None)
        order = F.struct("place", "position")
        firsts = each.groupBy("content_hash").agg(F.min_by(F.struct(*each.columns), order).alias("r")).select("r.*")
        fresh = tables.saved(firsts.join(counted.select("content_hash"), "content_hash", "left_anti"))
        # ids: pages one after the other, blocks within their page
        sizes = fresh.groupBy("page_id").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("page_id")) - F.col("n"))
        within_page = F.row_number().over(Window.partitionBy("page_id").orderBy("position"))
        fresh = fresh.join(sizes.select("page_id", "before"), "page_id").withColumns({"id": F.lit(self._last_id("content_blocks")) + F.col("before") + within_page, "collected_at": F.current_timestamp()})
        fresh = tables.saved(self._embedded(fresh.drop("place", "position", "before")))
        self.store.write("content_blocks", kept.unionByName(fresh, allowMissingColumns=True), site_id)
        self.store.write("postings", self.table("postings", site_id).join(away.select("id"), "id", "left_anti").unionByName(postings.postings(fresh)).repartition(F.col("gram")).sortWithinPartitions("gram", "id"), site_id)
        self.store.write("hash_counts", crawl.counted(self.table("hash_counts", site_id), away, fresh), site_id)
        after = self.table("content_blocks", site_id).count()

        columns = [f.name for f in TABLES["pages"].fields]
        others = own.join(pages.select("url"), "url", "left_anti")
        if prune:
            others = others.join(lost.select("id"), "id", "left_anti")
        self.store.write("pages", others.select(*columns).unionByName(pages.select(*columns)), site_id)
        now = datetime.now(UTC)
        status = "completed_with_warnings" if errors or blocked else "completed"
        self._add("crawl_runs", [{"site_id": site_id, "status": status, **counts, "previous_pages": previous, "retained_pages": counts["pages_crawled"], "stale_pages": gone, "prune_blocked": blocked, "errors": errors, "started_at": now, "finished_at": now}])
        self._change("sites", site_id, status="active" if counts["pages_crawled"] or counts["pages_skipped"] else "error", last_crawled_at=now)
        return {"site_id": site_id, **counts, "blocks": after, "errors": errors, "previous_pages": previous, "retained_pages": counts["pages_crawled"], "stale_pages": gone, "prune_blocked": blocked, "coverage": round(reached, 4)}

    def reindex(self, site_id: int, outdated_only: bool = False) -> dict:
        """Makes the vectors of a site's blocks anew, all of them or those of another signature or without a vector."""
        df = self.table("content_blocks", site_id)
        old = F.col("embedding").isNull() | ~F.col("embedding_version").eqNullSafe(F.lit(self.cfg.signature)) if outdated_only else F.lit(True)
        n = df.filter(old).count()
        if df.isEmpty():
            raise Invalid("the site has no blocks")
        if n:
            self.store.write("content_blocks", df.filter(~old).unionByName(self._embedded(df.filter(old))), site_id)
        return {"site_id": site_id, "reindexed_blocks": n, "embedding_version": self.cfg.signature}

    def build_index(self) -> VectorIndex:
        """Inverted lists over the stored vectors of the baseline, for checks that read a part of them."""
        fresh = self._baseline().filter(F.col("embedding_version") == self.cfg.signature)
        return VectorIndex.build(fresh, f"{self.root}/vector_index")

    def index(self) -> VectorIndex:
        return VectorIndex.opened(self.spark, f"{self.root}/vector_index")

    # ------------------------------------------------------------ stored content, checks, audits
    def content(self, keyword: str = "", site_id: int | None = None, page: int = 1, size: int = 20) -> tuple[int, int, DataFrame]:
        """Total, pages and one page of blocks, newest first; % and _ in the keyword are wildcards."""
        rows = self.table("content_blocks", site_id)
        if keyword.strip():
            like = f"%{keyword.strip()}%"
            near = postings.candidates(self.table("postings", site_id), like)
            if near is not None:
                # by the postings few blocks can match: a few are named, so the scan skips what holds none of them
                few = [r.id for r in near.select("id").limit(MOST_PUSHED + 1).collect()]
                rows = rows.filter(F.col("id").isin(few)) if len(few) <= MOST_PUSHED else rows.join(near.select("id"), "id", "left_semi")
            rows = rows.filter(F.col("original_content").ilike(like) | F.coalesce(F.col("page_title").ilike(like), F.lit(False)))
        rows = rows.join(self.table("sites").select(F.col("id").alias("site_id"), F.col("name").alias("site_name")), "site_id")
        total = rows.count()
        return total, -(-total // size), rows.orderBy(F.desc("collected_at"), F.desc("id")).offset((page - 1) * size).limit(size)

    def block(self, block_id: int) -> Row | None:
        return self.table("content_blocks").filter(F.col("id") == block_id).first()

    def _baseline(self) -> DataFrame:
        sites = self.table("sites").filter("site_type = 'baseline'").select(F.col("id").alias("site_id"), F.col("name").alias("site_name"))
        return self.table("content_blocks").join(sites, "site_id")

    def check(self, content: str, limit: int = 10, persist: bool = True, index: VectorIndex | None = None) -> list[Row]:
        """The most similar baseline blocks of a pasted text, with highlights; nearest vectors by `index`, or among all blocks."""
        content = content.strip()
        if not 3 <= len(content) <= 20_000 or not 1 <= limit <= 10:
            raise Invalid("content of 3 to 20000 characters, limit of 1 to 10")
        q = self.spark.createDataFrame([(0, None, content)], "query_id long, site_id long, original_content string")
        base = self._baseline()
        found = tables.saved(similarity.check(q, base, limit, self.cfg, index))
        shown = found.join(base.select("id", "site_id", "site_name", "page_title", "url", "content_type", "original_content"), "id").withColumn("highlight_segments", t.highlight(F.lit(content), F.col("original_content"))).orderBy("rank").collect()
        if persist:
            row = check_rows(q, found).first()
            normal = h.normal(content)
            results = [{"content_block_id": m.id, "overall_similarity": round(m.overall, 4), "risk_level": m.risk_level, "original_content": m.original_content, "highlight_segments": m.highlight_segments, "site_id": m.site_id, "site_name": m.site_name, "page_title": m.page_title, "url": m.url, "content_type": m.content_type, "lexical_similarity": round(m.lexical, 4), "semantic_similarity": round(m.semantic, 4), "exact_match": m.exact_match, "chemical_ratio": round(m.chemical_overlap, 4)} for m in shown]
            self._add("similarity_checks", [{"input_content": content, "normalized_content": normal, "content_hash": hashlib.sha256(normal.encode()).hexdigest(), "result_count": row.result_count, "top_score": row.top_score, "results": results, "created_at": datetime.now(UTC)}])
        return shown

    def audit(self, site_id: int) -> tuple[dict, DataFrame]:
        """Summary and findings of a candidate site's blocks against the baseline."""
        site = self._site(site_id)
        own = self.table("content_blocks", site_id)
        if site.site_type != "candidate" or own.isEmpty():
            raise Invalid("a candidate site with blocks is needed")
        q = own.select(F.col("id").alias("query_id"), "site_id", "original_content")
        matches = tables.saved(similarity.check(q, self._baseline(), self.cfg.audit_limit, self.cfg))
        return similarity.summary(matches, q).first().asDict(), similarity.findings(matches, self.cfg.findings_limit)
