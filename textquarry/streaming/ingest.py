"""Structured Streaming over a folder of page snapshots: each micro-batch is gated, extracted and deduplicated.

The batch's blocks are compared with the stored hashes of their site, so a block is written once a site whatever batch
brings it; batches are named by their id and rewritten whole, so a retried batch leaves no second copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from textquarry.functions import html as h
from textquarry.functions import text as t

PAGE_SCHEMA = "page_id long, site_id long, url string, html string"
BLOCK_SCHEMA = "site_id long, page_id long, url string, position int, content_type string, original_content string, content_hash string, batch long"


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of HTML pages; the first of each hash of a site counts."""
    rows = pages.filter(h.is_html(F.col("html"))).select("site_id", "page_id", "url", h.extract_page(F.col("html")).alias("p"))
    rows = rows.select("site_id", "page_id", "url", F.posexplode("p.blocks").alias("position", "b"))
    rows = rows.select("site_id", "page_id", "url", "position", "b.content_type", F.col("b.text").alias("original_content"), t.hash_of(t.normalized(F.col("b.text"))).alias("content_hash"))
    first = rows.groupBy("site_id", "content_hash").agg(F.min(F.struct("page_id", "position", "url", "content_type", "original_content")).alias("f"))
    return first.select("site_id", "f.page_id", "f.url", "f.position", "f.content_type", "f.original_content", "content_hash")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts the stream from `source` (Parquet files of PAGE_SCHEMA) into `target`, partitioned by batch."""

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        try:
            stored = session.read.schema(BLOCK_SCHEMA).parquet(target).filter(F.col("batch") != number).select("site_id", "content_hash")
            new = page_blocks(batch).join(stored, ["site_id", "content_hash"], "left_anti")
        except AnalysisException:  # the first batch has no target yet
            new = page_blocks(batch)
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(PAGE_SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
