"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

1. One pass over the texts gives each document the digest of its set of word 5-grams and its band hashes.
2. Documents with equal sets form a class; only one representative goes on, so copies never multiply.
3. Band hashes are shuffled; in each bucket of two or more, every member gets one edge to the bucket's smallest
   member. Connected components of these edges are the candidate clusters: two texts that share a band are in one.
4. Each representative's text, found again by its id and its digest, is sent to its cluster, and all pairs of a cluster
   are compared on their full sets by block matrix products. A cluster beyond BLOCK_ROWS members or BLOCK_GRAMS n-grams is cut into chunks and
   one task compares two chunks, so no task grows with a group. Pairs are never emitted as rows: a task returns,
   for each member, its number of links and the smallest member it is joined with.
5. Components of the verified links are the duplicate groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import parts, saved, skewed_left_join
from textquarry.llm.graph import components
from textquarry.llm.words import Words, mixed, pieces, text_buffers

GRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.999, 160
BLOCK_ROWS, BLOCK_GRAMS = 1024, 1 << 21


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands b and rows r: the largest r (fewest false candidates) for which b * r <= most hashes give a pair at the
    threshold a chance of 1 - (1 - threshold^r)^b >= recall of sharing a band."""
    best = None
    for r in range(1, most + 1):
        share = threshold**r
        b = 1 if share >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-share))
        if b * r <= most:
            best = b, r
    if best is None:
        raise ValueError(f"{most} hashes can't reach recall {recall} at {threshold}")
    return best


def gram_sets(words: Words, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram hashes and where each text's begin; a text of fewer words than `gram`, but not none, has one n-gram."""
    grams = words.grams(gram)
    count = np.diff(words.at)
    held = np.where(count >= gram, count - gram + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(held)])
    out = np.empty(at[-1], np.uint64)
    long = count >= gram
    if long.any():
        first = np.repeat(words.at[:-1][long] - np.concatenate([[0], np.cumsum(held[long])[:-1]]), held[long])
        target = np.repeat(at[:-1][long] - np.concatenate([[0], np.cumsum(held[long])[:-1]]), held[long])
        run = np.arange(held[long].sum())
        out[run + target] = grams[run + first]
    for d in np.flatnonzero(~long & (count > 0)):
        whole = words.hash[words.at[d] : words.at[d + 1]]
        out[at[d]] = mixed(np.array([sum((int(h) * (2 * i + 3)) for i, h in enumerate(whole)) + len(whole) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    return out, at


def _digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def _key(grams: np.ndarray, raw: bytes) -> bytes:
    """A text without words equals only the very same text."""
    return _digest(grams) if len(grams) else hashlib.blake2b(b"text" + raw, digest_size=16).digest()


def _sign(gram: int, bands: int, rows: int):
    random = np.random.Generator(np.random.PCG64(77))
    scale = random.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = random.integers(1, 2**63, bands * rows, dtype=np.uint64)
    weight = random.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "txt", 1 << 20):
                data, offsets = text_buffers(part.column(1))
                grams, at = gram_sets(Words(data, offsets), gram)
                n = part.num_rows
                full = np.flatnonzero(np.diff(at) > 0)
                banded = np.zeros((bands, len(full)), np.uint64)
                if len(full):
                    begin, work = at[full], np.empty(len(grams), np.uint64)
                    for j in range(bands * rows):
                        np.multiply(grams, scale[j], out=work)
                        np.add(work, shift[j], out=work)
                        banded[j // rows] += np.minimum.reduceat(work, begin) * weight[j % rows]
                    banded = mixed(banded)
                keys, sizes = [], np.zeros(n, np.int64)
                for d in range(n):
                    own = np.unique(grams[at[d] : at[d + 1]])
                    sizes[d] = len(own)
                    keys.append(_key(own, data[offsets[d] : offsets[d + 1]].tobytes() if not len(own) else b""))
                ends = np.zeros(n + 1, np.int32)
                ends[1:] = np.cumsum(np.isin(np.arange(n), full)) * bands
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(banded.T).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(keys, pa.binary()), pa.array(sizes), lists], names=["id", "digest", "key", "n_grams", "bands"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of 0/1 column blocks."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    out = np.zeros((m, m), np.float64)
    if len(column):
        column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]]))
        width = max(64, min(4096, (8 << 20) // m))
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            block = np.zeros((m, width), np.float32)
            block[owner[a:b], column[a:b] - low] = 1
            out += block @ block.T
    return out.astype(np.int64)


def _compare(keys: list[bytes], copies: list[int], sets: list[np.ndarray], side: list[int], threshold: float) -> list[tuple[bytes, bytes, int, int]]:
    """(key, smallest key it is joined with here, linked texts, linked documents) of each member; side: chunk of the
    member, when two chunks are compared with each other only."""
    m = len(keys)
    sizes = np.array([len(s) for s in sets])
    both = overlaps(sets)
    linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(linked, False)
    sides = np.array(side)
    if len(set(side)) > 1:
        linked &= sides[:, None] != sides[None, :]
    order = sorted(range(m), key=keys.__getitem__)
    root = list(range(m))
    seen = np.zeros(m, bool)
    for start in order:
        if seen[start]:
            continue
        front = np.zeros(m, bool)
        front[start] = True
        reached = front.copy()
        while front.any():
            front = linked[front].any(0) & ~reached
            reached |= front
        seen |= reached
        for i in np.flatnonzero(reached):
            root[i] = start
    weights = np.array(copies)
    return [(keys[i], keys[root[i]], int(linked[i].sum()), int(weights[linked[i]].sum())) for i in range(m)]


def _verify(gram: int, threshold: float):
    schema = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("texts", pa.int64()), ("others", pa.int64())])

    def finish(task: tuple | None, group: list[tuple]) -> list[tuple[bytes, bytes, int, int]]:
        keys, copies, sets, side = [], [], [], []
        for key, n, chunk, text in group:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            own = np.unique(gram_sets(Words(raw, np.array([0, len(raw)])), gram)[0])
            keys.append(key)
            copies.append(n)
            sets.append(own)
            side.append(chunk)
        # a chunk may be empty; the pairs inside the other one are counted by its own task
        alone = len(keys) < 2 or (task[1] != task[2] and len(set(side)) < 2)
        return [] if alone else _compare(keys, copies, sets, side, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        now, out = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != now:
                    out += finish(now, group)
                    now, group = row[:3], []
                # rows that repeat the representative's id and text come one after the other and count once
                if not group or group[-1][0] != row[3]:
                    group.append(row[3:])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out := finish(now, group):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _linked(docs: DataFrame, doc: str, text: str, gram: int, threshold: float, recall: float, block_rows: int, block_grams: int) -> DataFrame:
    """Per row: id, digest (of the text), group (a member's key), class_id, copies, texts, others."""
    spark = docs.sparkSession
    bands, rows = bands_and_rows(threshold, recall)
    txt = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc}`").alias("id"), txt.alias("txt"), F.unhex(F.md5(F.coalesce(txt, F.lit("")).cast("binary"))).alias("digest"))
    id_type = slim.schema["id"].dataType.simpleString()
    signs, _ = saved(slim.mapInArrow(_sign(gram, bands, rows), f"id {id_type}, digest binary, key binary, n_grams long, bands array<long>"), "signs")
    total = signs.count()
    rep = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "digest")).alias("rep")
    classes, _ = saved(signs.groupBy("key").agg(rep, F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "classes")

    buckets = classes.select("key", F.posexplode("bands").alias("band", "hash")).select("key", F.struct("band", "hash").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("key").alias("head"), F.count("*").alias("n")).filter("n > 1")
    edges = skewed_left_join(buckets, heads, "bucket", "n", bands * classes.count()).filter("key <> head")
    clusters = components(edges.select(F.col("key").alias("a"), F.col("head").alias("b")))
    members = clusters.select(F.col("node").alias("key"), F.col("component").alias("cluster")).unionByName(clusters.select(F.col("component").alias("key"), F.col("component").alias("cluster")).distinct())
    members, _ = saved(members.join(classes.select("key", "rep.id", "rep.digest", "copies", "n_grams"), "key"), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum("n_grams") / block_grams)).cast("int").alias("chunks"), F.count("*").alias("n"))
    placed = skewed_left_join(members, sizes, "cluster", "n", members.count()).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    # the text joins before it is sent to its chunk's tasks. The same plan at every size: small inputs would broadcast the members and hide the texts' shuffle
    with_text = placed.hint("merge").join(slim, (placed["digest"] == slim["digest"]) & placed["id"].eqNullSafe(slim["id"])).drop(slim["id"], slim["digest"])
    with_text = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    with_text = with_text.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "key", "copies", "chunk", "txt")
    spread = with_text.repartition(parts(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "key")
    found, _ = saved(spread.mapInArrow(_verify(gram, threshold), "key binary, root binary, texts long, others long"), "links")

    groups = components(found.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    counts = found.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("others").alias("others"))
    named = groups.join(classes.select(F.col("key").alias("node"), F.col("rep.id").alias("rep")), "node")
    ids = named.groupBy("component").agg(F.min("rep").alias("class_id"), F.count("*").alias("n"))
    linked = skewed_left_join(named, ids, "component", "n", named.count()).select(F.col("node").alias("key"), "component", "class_id").join(counts, "key", "left")
    verdict = classes.select("key", "rep.id", "copies").join(linked, "key", "left").select(
        "key",
        F.coalesce("component", "key").alias("group"),
        "copies",
        F.when(F.col("component").isNotNull(), F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.coalesce("texts", F.lit(0)).alias("texts"),
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("others"),
    )
    verdict, _ = saved(verdict, "verdict")
    return skewed_left_join(signs.select("id", "digest", "key"), verdict, "key", "copies", total).drop("key")


def near_duplicates(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, block_rows: int = BLOCK_ROWS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per document: doc, class_id, n_copies, n_text_links, n_links.

    class_id is the smallest id in the group of documents connected by similarities >= threshold (a null only where
    no member has an id); n_copies the documents with the same n-gram set, itself included; n_text_links the other
    sets linked with its own; n_links the other documents linked. A text shorter than `gram` words has one n-gram,
    its whole; null and empty texts, and others without words, link only to the very same text (null = empty).
    Repeated rows are copies of each other. Other columns are ignored.
    """
    linked = _linked(docs, doc, text, gram, threshold, recall, block_rows, block_grams)
    return linked.select(F.col("id").alias(doc), "class_id", F.col("copies").alias("n_copies"), F.col("texts").alias("n_text_links"), F.col("others").alias("n_links"))


def deduplicated(docs: DataFrame, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all columns: the one with the smallest id, a null id coming last.

    Of rows that repeat an id and a text the one stays whose other columns are smallest as JSON. An id with several texts
    stays with all of them if any leads its group. Rows without an id are told apart by their texts; one leads its group
    if no member has an id and its text digest is the smallest.
    """
    linked, _ = saved(_linked(docs, doc, text, GRAM, THRESHOLD, RECALL, BLOCK_ROWS, BLOCK_GRAMS).select("group", "id", "digest"), "linked")
    own = F.struct(F.col("id").isNull().alias("no"), "id", F.when(F.col("id").isNull(), F.col("digest")).alias("digest"))
    leads = linked.groupBy("group").agg(F.min(own).alias("lead"), F.count("*").alias("n"))

    def document(id: Column, digest: Column) -> Column:
        return F.unhex(F.md5(F.when(id.isNull(), digest).otherwise(F.concat(F.lit("id "), id.cast("string")).cast("binary"))))

    judged = skewed_left_join(linked, leads, "group", "n", linked.count()).select(document(F.col("id"), F.col("digest")).alias("_key"), (own == F.col("lead")).alias("leads"))
    gone = judged.groupBy("_key").agg(F.max("leads").alias("leads")).filter("not leads").select("_key")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.to_json(F.struct(*others)).alias("_rest"), digest.alias("_digest"), document(F.col(f"`{doc}`"), digest).alias("_key"))
    left = rows.join(gone, "_key", "left_anti")
    return left.groupBy("_key", "_digest").agg(F.min_by("row", F.struct(F.col("row").getField(text).isNull(), "_rest")).alias("row")).select("row.*")
