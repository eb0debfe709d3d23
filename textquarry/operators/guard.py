"""Broadcasts behind a check of the size, and joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 48 << 20
#: A key that holds at least one row in HOT_SHARE is hot, so at most HOT_SHARE keys are: a proven bound for a broadcast.
HOT_SHARE = 1000


def blocks_of(df: DataFrame, most: int = BLOCK_BYTES, row_bytes: int = 0) -> Iterator[DataFrame]:
    """df in hash blocks small enough to broadcast, by the measured size of its rows as text and `row_bytes` more a row (what is made of it)."""
    size = F.coalesce(F.sum("n"), F.lit(0)) + F.count("*") * row_bytes
    total = df.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(size).first()[0]
    n = max(1, -(-2 * total // most)) if total > most else 1
    for b in range(n):
        yield df if n == 1 else df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == b)


def skewed_left_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left join right on key, where right has one row a key and in `weight` the key's rows on the left (of `total`).

    The at most HOT_SHARE keys with a thousandth of all rows or more are broadcast and joined in place; all
    others are shuffled, at every size, so no task gets more than a thousandth of the rows by one key.
    """
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    others = [c for c in right.columns if c != key]
    first = left.join(F.broadcast(right.filter(is_hot).withColumn("_hot", F.lit(True))), key, "left")
    rest = first.filter("_hot is null").drop(*others).join(right.filter(~is_hot).hint("merge"), key, "left")
    return first.filter("_hot").unionByName(rest).drop("_hot")
