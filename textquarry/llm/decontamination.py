"""Benchmark decontamination by winnowing.

Training and test texts are reduced to k-gram fingerprints: in every window of `w` consecutive k-grams the
smallest hash is kept (the rightmost of equals). Two texts that share any span of k + w - 1 words keep a common
fingerprint inside it. With k + w - 1 equal to the window of the contract (10 words), every occurrence of an item's
window in a document is found from a joined fingerprint and then extended: the document's windows around it that keep
this fingerprint are compared, word by word, with the distinct windows of the items. Repeats cost one comparison a place.

Items of fewer words than a window form one window of their own length m. They get the same guarantee with
k = ceil(m / 2) and w = m - k + 1, one fingerprint class for each m from 1 to 9.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import remove, saved
from textquarry.llm.words import Words, pieces, text_buffers

WINDOW = 10
#: Bytes of item texts that one broadcast block holds, about; a larger benchmark is joined block after block.
BLOCK_BYTES = 8 << 20
#: Bytes of a piece that a longer item is cut into; pieces share all but one word of a window, so no window is lost.
PIECE_BYTES = 1 << 20


def gram_words(m: int) -> tuple[int, int]:
    """k and w with k + w - 1 = m."""
    k = (m + 1) // 2
    return k, m - k + 1


def winnowed(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the kept grams: the rightmost smallest of each w consecutive ones."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = grams[j : j + n]
        lower = other <= least
        least = np.where(lower, other, least)
        at = np.where(lower, np.arange(j, j + n), at)
    return np.unique(at)


class ItemIndex:
    """The distinct windows of a block of items by window length, with the fingerprints that winnowing keeps of them.

    A window keeps one fingerprint, wherever it stands, so a window of an item and an equal one of a document meet in it.
    """

    def __init__(self, items: list[tuple[str, str]]):
        self.ids: list[str] = [i for i, _ in items]
        #: For each length the kept fingerprints, sorted, and the number of each window by its words.
        self.by_length: dict[int, tuple[np.ndarray, dict[bytes, int]]] = {}
        #: The items that hold a window, by its number.
        self.holders: list[list[int]] = []
        kept: dict[int, set[int]] = {}
        for number, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
            words = Words(raw, np.array([0, len(raw)]))
            n = len(words.hash)
            if not n:
                continue
            m = min(n, WINDOW)
            k, w = gram_words(m)
            kept.setdefault(m, set()).update(words.grams(k)[winnowed(words.grams(k), w)].tolist())
            _, numbers = self.by_length.setdefault(m, (np.empty(0, np.uint64), {}))
            for i in range(n - m + 1):
                at = numbers.setdefault(words.slice_key(i, m), len(self.holders))
                if at == len(self.holders):
                    self.holders.append([])
                if not self.holders[at] or self.holders[at][-1] != number:
                    self.holders[at].append(number)
        for m, (_, numbers) in self.by_length.items():
            self.by_length[m] = np.array(sorted(kept[m]), np.uint64), numbers

    def hits(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(window number, first word, words) of every place in the texts of `words` where an item's window stands, once each."""
        for m, (known, numbers) in self.by_length.items():
            k, w = gram_words(m)
            grams = words.grams(k)
            # A gram across two texts must not push a text's own gram out of its window, so windows are cut at text ends.
            start, place = chosen_within(grams, w, words.at, k)
            mine = grams[place]
            # the windows around a fingerprint that an item has, too: compared word by word
            for at in start[known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine].tolist():
                number = numbers.get(words.slice_key(at, m))
                if number is not None:
                    yield number, at, m


def chosen_within(grams: np.ndarray, w: int, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First grams of all windows of w grams, for many texts at once, and the place of the one that each keeps, the rightmost smallest;
    windows that reach over a text's end don't count."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    least, where = grams[:n].copy(), np.arange(n, dtype=np.int32)
    place = np.arange(n, dtype=np.int32)
    for j in range(1, w):
        other = grams[j : j + n]
        lower = other <= least
        np.copyto(least, other, where=lower)
        np.copyto(where, place + np.int32(j), where=lower)
    whole = np.zeros(n + 1, np.int32)
    length = np.diff(at) - (k + w - 1) + 1
    begin = at[:-1][length > 0]
    np.add.at(whole, np.minimum(begin, n), 1)
    np.add.at(whole, np.minimum(begin + length[length > 0], n), -1)
    start = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    return start, where[start]


def _covered(spans: list[int]) -> int:
    """Words in the union of (first << 8 | words) spans, given in order."""
    total, reach = 0, 0
    for x in spans:
        first, m = x >> 8, x & 255
        total += max(0, first + m - max(first, reach))
        reach = max(reach, first + m)
    return total


def _scan(index_of, keep: list[str], last: bool):
    """Adds one block's hits to the columns spans and items; the last block's pass drops the text and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = index_of.value
        for batch in batches:
            for part in pieces(batch, "txt"):
                column = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                words = Words(*text_buffers(column["txt"]))
                spans = [set(x) for x in column["spans"].to_pylist()]
                items = [set(x) for x in column["items"].to_pylist()]
                held: dict[int, set[int]] = {}
                for number, at, m in index.hits(words):
                    doc = int(np.searchsorted(words.at, at, "right")) - 1
                    spans[doc].add(at - int(words.at[doc]) << 8 | m)
                    held.setdefault(doc, set()).add(number)
                for doc, numbers in held.items():
                    items[doc].update(index.ids[i] for number in numbers for i in index.holders[number])
                out = {c: column[c] for c in keep}
                if last:
                    hit = [_covered(sorted(x)) for x in spans]
                    out |= {
                        "n_words": pa.array(np.diff(words.at), pa.int64()),
                        "n_hit": pa.array(hit, pa.int64()),
                        "n_items": pa.array([len(x) for x in items], pa.int64()),
                        "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]),
                        "contaminated": pa.array([h > 0 for h in hit]),
                    }
                else:
                    out |= {"txt": column["txt"], "spans": pa.array(map(sorted, spans), pa.list_(pa.int64())), "items": pa.array(map(sorted, items), pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _cut(piece_bytes: int):
    """(i, t) with long texts in pieces of at least a window each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) <= piece_bytes:
                    yield pa.RecordBatch.from_pydict({"i": pa.array([item]), "t": pa.array([text])})
                    continue
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                n, begin, end = len(words.hash), 0, 0
                while end < n:
                    end = int(np.searchsorted(words.end, words.start[begin] + piece_bytes, "right"))
                    end = min(n, max(end, begin + WINDOW))
                    yield pa.RecordBatch.from_pydict({"i": pa.array([item]), "t": pa.array([raw[words.start[begin] : words.end[end - 1]].decode("utf-8", "surrogatepass")])})
                    begin = max(end - WINDOW + 1, 0)

    return run


def blocks(benchmark: DataFrame, item: str, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """How many blocks are left, and the items of the next; one block at a time is collected, after the bytes have been summed.

    A benchmark beyond `most` is cut into pieces and dealt by hash over enough blocks to be half full on average.
    """
    items = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null and i is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = -(-2 * total // most) if total > most else 1
    if n > 1:
        items, _ = saved(items.mapInArrow(_cut(max(1, min(PIECE_BYTES, most // 8))), "i string, t string"), "benchmark")
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    used = sorted(r.b for r in items.select(block.alias("b")).distinct().collect()) if n > 1 else [0]
    for k, b in enumerate(used):
        mine = items.filter(block == b) if n > 1 else items
        yield len(used) - k - 1, [(r.i, r.t) for r in mine.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: `keep` columns, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; an item of no words, or with a null id, is not looked for;
    repeated item ids count once; repeated documents each get a row; an empty benchmark hits nothing. Extra columns
    are only carried when named in `keep`. The driver and each worker hold one block of items; between blocks the documents
    and their hits so far are written to the shared folder.
    """
    spark = docs.sparkSession
    keep = list(keep or [])
    names = [f"c{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias("txt"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    counted = T.StructType([df.schema[n] for n in names]).add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    path = None
    for left, block in blocks(benchmark, item, item_text, block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(block))
        df = df.mapInArrow(_scan(index, names, not left), df.schema if left else counted)
        if left:
            before, (df, path) = path, saved(df, "hits")
            index.unpersist()
            if before:
                remove(spark, before)
    for c, n in zip(keep, names, strict=True):
        df = df.withColumnRenamed(n, c)
    return df


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("txt"))
    return decontaminate(whole, benchmark, text="txt", keep=["row"]).filter(~F.col("contaminated")).select("row.*")
