"""Background jobs and crawl runs as tables: latest rows, active jobs, recovery, idempotent creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("queued", "running")


def latest(jobs: DataFrame) -> DataFrame:
    """The latest job of each site and type; a partial maximum, so no site's history meets in one task."""
    return jobs.groupBy("site_id", "job_type").agg(F.max(F.struct("id", "status")).alias("j")).select("site_id", "job_type", "j.id", "j.status")


def active(jobs: DataFrame) -> DataFrame:
    return latest(jobs.filter(F.col("status").isin(*ACTIVE)))


def history(runs: DataFrame, limit: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("id")))
    return runs.withColumn("rank", rank).filter(F.col("rank") <= limit)


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, what was queued or running has failed."""
    cut = F.col("status").isin(*ACTIVE)
    return jobs.withColumns({"error": F.when(cut, "interrupted").otherwise(F.col("error")), "status": F.when(cut, "error").otherwise(F.col("status"))})


def created(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """New queued rows for asked (site_id, job_type) pairs that have no active job."""
    return asked.distinct().join(active(jobs).select("site_id", "job_type"), ["site_id", "job_type"], "left_anti").withColumn("status", F.lit("queued"))
