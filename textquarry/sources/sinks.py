"""Sinks: persisted checks and table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_rows(queries: DataFrame, matches: DataFrame, first_id: int = 1) -> DataFrame:
    """One similarity_checks row a query: result_count, top_score and the results as an array, best first."""
    best = matches.groupBy("query_id").agg(
        F.count("*").cast("int").alias("result_count"),
        F.round(F.max("overall"), 4).alias("top_score"),
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("content_block_id"), F.round("overall", 4).alias("overall_similarity"), "risk_level", F.round("lexical", 4).alias("lexical_similarity"), F.round("semantic", 4).alias("semantic_similarity"), "exact_match", F.round("chemical_overlap", 4).alias("chemical_ratio")))).alias("results"),
    )
    out = queries.select("query_id", F.col("original_content").alias("input_content")).join(best, "query_id", "left")
    out = out.withColumn("result_count", F.coalesce("result_count", F.lit(0)))
    return out.withColumn("id", F.row_number().over(Window.orderBy("query_id")) + first_id - 1)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def snapshot(df: DataFrame, path: str, version: int) -> str:
    """A new version folder; the one being read is never overwritten."""
    target = f"{path}/version={version:08d}"
    df.write.mode("error").parquet(target)
    return target
