"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "texts": T.ArrayType(T.StringType())}


def _of(fields: str, **more: T.DataType) -> T.StructType:
    """A struct of "name type, ..."; no session is needed, as Spark's own DDL parser does."""
    return T.StructType([T.StructField(n, {**_TYPES, **more}[k]) for n, k in (x.split() for x in fields.split(", "))])


SITES = _of("id long, name string, domain string, sitemap_url string, site_type string, include_patterns texts, exclude_patterns texts, allowed_query_params texts, crawler_max_pages int, request_delay_ms int, min_crawl_coverage double, status string, last_crawled_at timestamp, created_at timestamp, updated_at timestamp")
PAGES = _of("id long, site_id long, url string, title string, meta_description string, http_status int, content_hash string, crawled_at timestamp")
SEGMENTS = T.ArrayType(_of("text string, matched boolean"))
CONTENT_BLOCKS = _of("id long, site_id long, page_id long, page_title string, url string, content_type string, original_content string, normalized_content string, content_hash string, embedding vector, embedding_version string, collected_at timestamp", vector=T.ArrayType(T.DoubleType()))
#: The 3-grams of a site's blocks.
POSTINGS = _of("gram string, id long, site_id long")
#: How many blocks of a site hold a text, by its hash.
HASH_COUNTS = _of("site_id long, content_hash string, n long")
RESULT = _of("content_block_id long, overall_similarity double, risk_level string, original_content string, highlight_segments segments, site_id long, site_name string, page_title string, url string, content_type string, lexical_similarity double, semantic_similarity double, exact_match boolean, chemical_ratio double", segments=SEGMENTS)
SIMILARITY_CHECKS = _of("id long, input_content string, normalized_content string, content_hash string, result_count int, top_score double, results results, created_at timestamp", results=T.ArrayType(RESULT))
BACKGROUND_JOBS = _of("id long, site_id long, job_type string, status string, progress int, result string, error string, created_at timestamp, started_at timestamp, finished_at timestamp")
CRAWL_RUNS = _of("id long, site_id long, status string, pages_discovered int, pages_crawled int, pages_skipped int, previous_pages int, retained_pages int, stale_pages int, prune_blocked boolean, errors texts, started_at timestamp, finished_at timestamp")

SITE_STATUS = ("active", "paused", "error")
SITE_TYPES = ("baseline", "candidate")
CONTENT_TYPES = ("title", "meta_description", "h1", "h2", "h3", "paragraph")
JOB_TYPES = ("crawl", "preview", "audit", "reindex")
JOB_STATUS = ("queued", "running", "completed", "error")
RUN_STATUS = ("running", "completed", "completed_with_warnings", "error")
