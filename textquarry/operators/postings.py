"""Which blocks can match a keyword: postings of character 3-grams, sorted by gram.

A pattern's literal pieces of three characters or more must stand in a matching text, so all their 3-grams must; the
few blocks that hold all of them are then compared with the whole pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import text as t

LEAST = 3


def grams(text: Column) -> Column:
    return t.ngrams(F.lower(F.coalesce(text, F.lit(""))), LEAST)


def postings(blocks: DataFrame) -> DataFrame:
    """(gram, id, site_id) of content and page title; sorted by gram, so a search reads the row groups of its grams only."""
    both = F.array_union(grams(F.col("original_content")), grams(F.col("page_title")))
    each = blocks.select(F.explode(both).alias("gram"), "id", "site_id")
    return each.repartition(F.col("gram")).sortWithinPartitions("gram", "id")


def literals(pattern: str) -> list[str]:
    """The pieces between wildcards; a backslash takes the next character as it is."""
    out, now, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            out.append(now)
            now = ""
        else:
            at += c == "\\"
            now += pattern[at : at + 1]
        at += 1
    return [x for x in [*out, now] if len(x) >= LEAST]


def candidates(table: DataFrame, pattern: str) -> DataFrame | None:
    """(id, site_id) of the blocks that hold all 3-grams of the pattern's pieces; None if it has no such piece."""
    spark: SparkSession = table.sparkSession
    pieces = literals(pattern)
    if not pieces:
        return None
    wanted = spark.range(1).select(F.array_distinct(F.flatten(F.array(*[grams(F.lit(x)) for x in pieces]))).alias("g")).first().g
    wanted = [g for g in wanted if len(g) >= LEAST]
    if not wanted:
        return None
    held = table.filter(F.col("gram").isin(wanted)).groupBy("id", "site_id").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") == len(wanted)).select("id", "site_id")
