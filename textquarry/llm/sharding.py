"""Longest-processing-time sharding of groups that must stay together.

Groups (here: equal texts) are sorted by size, largest first, and each goes to the least-loaded shard through a heap.
The order of groups of one size doesn't matter to the loads, so the driver only sees how many groups there are of each
size. D distinct sizes need at least D (D + 1) / 2 bytes of text, so for B bytes in all D <= sqrt(2 B): 0.25 million
sizes for 30 GB, 14 million for 100 TB. A run of many groups of one size is dealt by the water level it fills the
shards to, which is what the heap would give, so time on the driver doesn't grow with the number of groups.

Groups then find their place by their rank among the groups of their size. Ranks and slots are counted in two steps
(rows in each hash bucket, then within the bucket), so no task has to number a whole size or a whole shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import saved, skewed_left_join

SHARDS = 16
#: Rows that one bucket of a two-step numbering holds, about.
BUCKET_ROWS = 20_000
#: Runs of fewer equal groups go through the heap one by one.
HEAP_RUN = 64


def dealt(loads: list[int], size: int, count: int) -> list[int]:
    """Groups each shard gets when `count` groups of `size` go one by one to the least-loaded shard; loads are updated.

    Equal to a heap of (load, shard): the count smallest of all (load_j + size * k, j), k = 0, 1, ...
    """
    got = [0] * len(loads)
    if count <= HEAP_RUN or size == 0:
        heap = [(x, j) for j, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(count):
            load, j = heap[0]
            got[j] += 1
            heapq.heapreplace(heap, (load + size, j))
    else:

        def below(level: int) -> int:
            return sum((level - x - 1) // size + 1 for x in loads if x < level)

        low, high = min(loads), max(loads) + size * (count // len(loads) + 2)
        while low < high:  # the highest level with at most count offers strictly below it
            mid = (low + high + 1) // 2
            if below(mid) <= count:
                low = mid
            else:
                high = mid - 1
        for j, x in enumerate(loads):
            got[j] = (low - x - 1) // size + 1 if x < low else 0
        left = count - sum(got)
        for j, x in enumerate(loads):  # offers at exactly this level, by shard
            if left and x + size * got[j] == low:
                got[j] += 1
                left -= 1
    for j, n in enumerate(got):
        loads[j] += n * size
    return got


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(size, for each shard the rank after its last group of that size) from (size, groups), largest size first."""
    loads, out = [0] * shards, []
    for size, count in sorted(sizes, reverse=True):
        ends, total = [], 0
        for n in dealt(loads, size, count):
            total += n
            ends.append(total)
        out.append((size, ends))
    return out


def numbered(df: DataFrame, key: str, order: list[str], into: str, spread: str, total: int) -> DataFrame:
    """df (of `total` rows) with `into`: 0, 1, ... within each key, by a hash bucket of column `spread` first and `order` within it."""
    totals = df.groupBy(key).agg(F.count("*").alias("_n"))
    # one row a key; sizes of buckets follow the rows of the key
    cut = F.ceil(F.col("_n") / BUCKET_ROWS).cast("int")
    bucketed = skewed_left_join(df, totals, key, "_n", total).withColumn("_b", F.pmod(F.xxhash64(spread), F.coalesce(cut, F.lit(1)).cast("long"))).drop("_n")
    counts = bucketed.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_start", F.coalesce(before, F.lit(0))).filter("_b > 0").select(key, "_b", "_start")
    within = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    return bucketed.withColumn("_at", within).join(starts, [key, "_b"], "left").withColumn(into, (F.coalesce("_start", F.lit(0)) + F.col("_at")).cast("long")).drop("_b", "_at", "_start")


def shard_groups(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per document: doc, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes (null: none) plus 1. Equal texts are one group and share a shard; null and the empty
    text are equal. Repeated rows get a slot each. A group larger than a shard's fair share has its shard nearly to
    itself. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    txt = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(F.col(f"`{doc}`").alias("id"), (F.octet_length(txt) + 1).cast("long").alias("size"), F.crc32(txt.cast("binary")).alias("crc"), F.unhex(F.md5(txt.cast("binary"))).alias("key"))
    slim, _ = saved(slim, "shard-rows")
    groups, _ = saved(slim.groupBy("key").agg(F.count("*").alias("copies"), F.sum("size").alias("weight")), "shard-groups")
    total = slim.count()
    plan = schedule([tuple(r) for r in groups.groupBy("weight").count().collect()], shards)
    ends = spark.createDataFrame([(size, ends, ends[-1]) for size, ends in plan], "weight long, ends array<long>, n long")
    n = sum(ends[-1] for _, ends in plan)
    # each step is written: a skewed join reads its left side twice, so nested ones would double the plan each time
    ranked, _ = saved(numbered(groups, "weight", ["key"], "rank", "key", n), "shard-ranks")
    placed = skewed_left_join(ranked, ends, "weight", "n", n).select("key", "copies", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).alias("shard"))
    placed, _ = saved(placed, "shard-places")
    joined, _ = saved(skewed_left_join(slim, placed, "key", "copies", total).select("id", "size", "crc", "key", "shard"), "shard-joined")
    out = numbered(joined, "shard", ["id", "key"], "slot", "id", total)
    return out.select(F.col("id").alias(doc), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
