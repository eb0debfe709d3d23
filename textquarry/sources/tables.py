"""The engine's tables, bound to Parquet snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.session import shared_folder, steady


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return steady(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, where it comes in fewer files than there are cores (one small file would keep one core busy).

    A table of many splits, as any large one is, stays as it is: no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles()) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else cores
    return df.repartition(cores, key) if files < cores else df


def site_of(source) -> F.Column:
    return F.regexp_extract(source, r"(\d+)$", 1).cast("long")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site a source; every fifth is a candidate."""
    found = read(spark, sf_dir, "documents").select("source").distinct()
    return found.select(
        site_of(F.col("source")).alias("site_id"),
        F.col("source").alias("site_name"),
        F.concat(F.col("source"), F.lit(".example.com")).alias("domain"),
        F.when(site_of(F.col("source")) % 5 == 0, "candidate").otherwise("baseline").alias("site_type"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block a document."""
    return spread(read(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), site_of(F.col("source")).alias("site_id"), F.col("source").alias("site_name"), F.when(site_of(F.col("source")) % 5 == 0, "candidate").otherwise("baseline").alias("site_type"), F.col("text").alias("original_content"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block a line, short ones too: which are long enough is the rule of whoever asks. The id is doc_id * 10000000 + line."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return docs.select((F.col("doc_id") * 10_000_000 + F.col("line")).alias("id"), "doc_id", "line", site_of(F.col("source")).alias("site_id"), "content")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/textquarry/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, **options: str) -> DataFrame:
    """df written to the folder that all executors share, and reread: cuts the lineage of driver loops."""
    spark = df.sparkSession
    path = fresh_folder(spark, "saved")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
