"""Substring deduplication by Rabin-Karp hashes of all windows.

1. A pass over the whole texts hashes each window of WINDOW consecutive words by a polynomial that rolls along the text. Within a piece
   of the input, all but the first of equal windows are settled at once, so a passage that every document holds leaves a piece once.
2. The other windows are dealt into buckets and shuffled. A window's bucket is that of the least hash of the GRAM words' spans inside it: equal
   windows have the same one, and neighbours mostly too, so what goes over the wire is 8 bytes a window and a few bytes a run of neighbours.
3. Each bucket counts its hashes. Of equal windows the one that starts first stays, by (document, place); the others go.
4. Each document gets its windows that go, merged into maximal intervals of words, and is written without them.

The hash has 64 bits, and only windows of one bucket are compared: two different windows among 10^13 in 10^6 buckets are taken for
equal with a chance of some percent. Buckets are as many as BUCKET_BYTES of text need, so a task's memory does not grow with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import HOT_SHARE, parts, saved, skewed_left_join
from textquarry.llm.words import mixed, pieces

WINDOW, GRAM = 20, 5
#: Bytes of text whose windows a bucket holds on average; of a piece hashed at once; of a long text split at once.
BUCKET_BYTES, PIECE_BYTES, SPLIT_BYTES = 32 << 20, 4 << 20, 1 << 20
#: Bases of the polynomials modulo 2^64, odd.
BASE, GRAM_BASE = 0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4B
_BLANKS = b" \t\n\v\f\r"


def split(raw: bytes) -> Iterator[list[bytes]]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, some at a time, so a very long text is never a list of all its words."""
    at = 0
    while len(raw) - at > 2 * SPLIT_BYTES:
        ends = [e for b in _BLANKS if (e := raw.find(bytes([b]), at + SPLIT_BYTES)) >= 0]
        if not ends:
            break
        yield raw[at : min(ends)].split()
        at = min(ends)
    yield raw[at:].split()


def word_hashes(raw: bytes) -> np.ndarray:
    found = [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) for words in split(raw)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def rolled(hashes: np.ndarray, k: int, base: int) -> np.ndarray:
    """The polynomial hash of the k words from each word on, from one running sum: that of the next is the last's minus the
    word that leaves plus the one that enters, divided by the base."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers = np.full(len(hashes), base, np.uint64)
    powers[0] = 1
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * np.cumprod(powers), out=total[1:])
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    return mixed((total[k:] - total[:n]) * np.cumprod(back))


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least hash of the spans of `gram` words in each window."""
    least, width, wanted = rolled(hashes, gram, GRAM_BASE), 1, window - gram + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of runs, from a flag for each place that begins one."""
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def _intervals(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first, length) of runs of consecutive starts; sorted and distinct."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first, _ = _ends(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], start[last] - start[first] + 1


def _later(group: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which entries start later than the first of their group, by (rank, start)."""
    order = np.lexsort((start, rank, group))
    g, r, s = group[order], rank[order], start[order]
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    first, length = _ends(new)
    head = np.repeat(first, length)
    out = np.empty(len(g), bool)
    out[order] = (r != r[head]) | (s != s[head])
    return out


SLICE = "bucket int, ids array<{id}>, digests binary, docs binary, starts binary, lengths binary, hashes binary"


def _row(bucket: int, ids: pa.Array, digests: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    """A slice of runs; documents are numbered within it."""
    used, place = np.unique(doc, return_inverse=True)
    listed = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), ids.take(pa.array(used)))
    numbers = [digests[used].astype(np.int64), place.astype(np.int32), start.astype(np.int32), length.astype(np.int32), hashes]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), listed, *(pa.array([x.tobytes()], pa.binary()) for x in numbers)], names=[x.split()[0] for x in SLICE.split(", ")])


def _hashed(window: int, gram: int, buckets: int):
    """Slices of runs for the buckets; bucket -1 - n has the windows that a piece has settled, to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = 0
        for batch in batches:
            for part in pieces(batch, "txt", PIECE_BYTES):
                # repeated rows of one id and text get one verdict
                digests = part.column(1).to_numpy()
                ids = part.column(0)
                rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
                order = np.lexsort((digests, rank))
                once = np.ones(len(order), bool)
                once[1:] = (rank[order][1:] != rank[order][:-1]) | (digests[order][1:] != digests[order][:-1])
                docs = order[once]
                texts = part.column(2)
                words = [word_hashes((texts[d].as_py() or "").encode("utf-8", "surrogatepass")) for d in docs.tolist()]
                n = np.array([len(w) for w in words], np.int64)
                if not n.size or n.max() < window:
                    continue
                every = np.concatenate(words)
                del words
                begin = np.cumsum(n) - n
                valid = np.maximum(n - window + 1, 0)
                doc = np.repeat(np.arange(len(docs)), valid)
                start = np.arange(len(doc)) - np.repeat(np.cumsum(valid) - valid, valid)
                at = begin[doc] + start
                hashes = rolled(every, window, BASE)[at]
                bucket = (mixed(anchors(every, window, gram)[at]) >> np.uint64(32)) % np.uint64(buckets)
                bucket = bucket.astype(np.int32)
                # equal windows of the piece: the first by (id, place) goes on, with those that tie with it
                sort = np.argsort(hashes, kind="stable")
                same = np.zeros(len(sort) + 1, bool)
                same[1:-1] = hashes[sort][1:] == hashes[sort][:-1]
                many = np.flatnonzero(same[1:] | same[:-1])
                if len(many):
                    group, entry = np.cumsum(~same[:-1])[many], sort[many]
                    gone = entry[_later(group, rank[docs][doc[entry]], start[entry])]
                    if len(gone):
                        settled += 1
                        owner, first, length = _intervals(doc[gone], start[gone])
                        yield _row(-1 - settled % 1024, ids, digests, docs[owner], first, length, np.empty(0, np.uint64))
                        keep = np.ones(len(doc), bool)
                        keep[gone] = False
                        doc, start, hashes, bucket = doc[keep], start[keep], hashes[keep], bucket[keep]
                if not len(doc):
                    continue
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (bucket[1:] != bucket[:-1])
                first, length = _ends(new)
                runs = np.argsort(bucket[first], kind="stable")
                first, length = first[runs], length[runs]
                windows = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(len(doc))
                hashes, own = hashes[windows], bucket[first]
                ends = np.cumsum(length)
                cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                for low, high in zip(cut.tolist(), [*cut[1:].tolist(), len(own)], strict=True):
                    f = first[low:high]
                    yield _row(int(own[low]), ids, digests, docs[doc[f]], start[f], length[low:high], hashes[ends[low] - length[low] : ends[high - 1]])

    return run


def _verdict(ids: pa.Array, digests: np.ndarray, doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """One row a document: its intervals of windows that go, sorted by document."""
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    pairs = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32) * 2), pa.array(np.column_stack([start, length]).astype(np.int32).reshape(-1)))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[first])), pa.array(digests[doc[first]]), pairs], names=["id", "digest", "windows"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that go, from slices sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            bucket = batch.column(0)[i].as_py()
            if bucket != now:
                yield from _finished(now, held)
                now, held = bucket, []
            held.append(batch.slice(i, 1))
    yield from _finished(now, held)


def _finished(bucket: int | None, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    ids = pa.concat_arrays([b.column(1)[0].values for b in held])
    digests, doc, start, length, hashes = ([np.frombuffer(b.column(c)[0].as_buffer(), kind) for b in held] for c, kind in ((2, np.int64), (3, np.int32), (4, np.int32), (5, np.int32), (6, np.uint64)))
    many = np.cumsum([0, *map(len, digests)])
    doc = np.concatenate([d + base for d, base in zip(doc, many[:-1], strict=True)])
    digests, start, length = np.concatenate(digests), np.concatenate(start), np.concatenate(length)
    if bucket < 0:
        yield _verdict(ids, digests, doc, start, length)
        return
    hashes = np.concatenate(hashes)
    held.clear()
    sort = np.argsort(hashes)
    hashes = hashes[sort]
    same = np.zeros(len(sort) + 1, bool)
    same[1:-1] = hashes[1:] == hashes[:-1]
    del hashes
    repeated = np.flatnonzero(same[1:] | same[:-1])
    if not len(repeated):
        return
    group, entry = np.cumsum(~same[:-1])[repeated], sort[repeated]
    del sort, same
    begin = np.cumsum(length) - length
    run = np.searchsorted(begin, entry, "right") - 1
    owner, place = doc[run].astype(np.int64), start[run] + (entry - begin[run])
    rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    gone = _later(group, rank[owner], place)
    if gone.any():
        yield _verdict(ids, digests, *_intervals(owner[gone], place[gone]))


def _cut(window: int):
    """n_words, n_removed, kept_sha256 and spans of each text by its windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "txt", PIECE_BYTES):
                n_words, n_removed, digests, spans = [], [], [], []
                for text, windows in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    merged = _merged([x for w in windows or () for x in w], window)
                    found, size = hashlib.sha256(), 0
                    kept = 0
                    for words in split((text.as_py() or "").encode("utf-8", "surrogatepass")):
                        some = _outside(words, size, merged) if merged else words
                        if some:
                            found.update(b" " + b" ".join(some) if kept else b" ".join(some))
                            kept += len(some)
                        size += len(words)
                    n_words.append(size)
                    n_removed.append(size - kept)
                    digests.append(found.hexdigest())
                    spans.append(merged)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], names=["id", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


def _merged(windows: list[int], window: int) -> list[list[int]]:
    """Maximal intervals [first, end) of words from (first window, windows) pairs."""
    out: list[list[int]] = []
    for first, n in sorted(zip(windows[::2], windows[1::2], strict=True)):
        end = first + n - 1 + window
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def _outside(words: list[bytes], base: int, spans: list[list[int]]) -> list[bytes]:
    out, at = [], 0
    for first, end in spans:
        if end > base and first < base + len(words):
            out += words[at : max(at, first - base)]
            at = max(at, min(len(words), end - base))
    return out + words[at:]


def deduplicated(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row: doc, n_words, n_removed, kept_sha256 and spans, the removed intervals [first, end) of words.

    A word goes if a window of `window` words over it has the same words as one that starts earlier: in a smaller doc, or
    in the same doc at a smaller place. Rows with one doc are the same document: of equal windows at the same place
    none is earlier. Ids that are null are one document that comes last. Null and empty texts have no words; texts of fewer words than a
    window lose none; an empty table gives no rows. Words are compared as they stand. Other columns are ignored.
    """
    spark = docs.sparkSession
    txt = F.col(f"`{text}`")
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.xxhash64(F.coalesce(txt, F.lit(""))).alias("digest"), txt.alias("txt"))
    id_type = slim.schema["id"].dataType.simpleString()
    rows, _ = saved(slim.groupBy("id", "digest").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("txt"), F.lit(0)).cast("long")).alias("bytes")), "rows")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    n = parts(spark)
    slices = slim.mapInArrow(_hashed(window, gram, max(n, -(-total.bytes // bucket_bytes))), SLICE.format(id=id_type))
    dealt = slices.repartition(n, "bucket").sortWithinPartitions("bucket")
    gone = dealt.mapInArrow(_counted, f"id {id_type}, digest long, windows array<int>")
    verdicts = gone.groupBy(F.struct("id", "digest").alias("key")).agg(F.collect_list("windows").alias("windows"))
    # rows that repeat an id and a text may be hot: their keys, at most HOT_SHARE, are joined by broadcast
    hot = rows.filter(F.col("n") * HOT_SHARE >= F.lit(max(total.n, 2 * HOT_SHARE))).select(F.struct("id", "digest").alias("key"), F.col("n").alias("rows"))
    verdicts, _ = saved(verdicts.join(F.broadcast(hot), "key", "left").na.fill(1, ["rows"]), "verdicts")
    keyed = slim.select("id", "txt", F.struct("id", "digest").alias("key"))
    joined = skewed_left_join(keyed, verdicts, "key", "rows", max(total.n, 2 * HOT_SHARE)) if not hot.isEmpty() else keyed.join(verdicts.drop("rows"), "key", "left")
    out = joined.select("id", "txt", "windows").mapInArrow(_cut(window), f"id {id_type}, n_words long, n_removed long, kept_sha256 string, spans array<array<int>>")
    return out.withColumnRenamed("id", doc)
