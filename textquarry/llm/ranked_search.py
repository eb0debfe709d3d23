"""Ranked lexical search over a tiered index.

1. One pass over the documents counts the items' terms in every whole text. The postings are written in blocks of documents;
   documents, terms and document frequencies are then summed over all of them.
2. A posting's impact is its term's weight times its saturated frequency, in 64-bit whole numbers. The index has a row a
   block and a column a tier: the first tier holds the SHARES[0] highest impacts of all postings, and so on; a search of the first tiers reads only
   their columns. What a term can still add below a tier is bounded by the tier's least impact and by the term's largest.
3. Each round scores the items that are left on one tier more. The tenth best partial score of an item is a lower bound of its
   tenth best score. If the bounds of all terms together stay below it, no document unseen so far can be among the ten:
   the item is proven, and only documents whose partial score and bounds reach that mark get their scores completed from the lower tiers.
   Items without proof fall through to the next tier; the last one is all postings, hence exact.

Sums are whole numbers: in doubles below 2^53, else in two halves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import saved
from textquarry.llm.words import Words, pieces, text_buffers
from textquarry.operators.guard import blocks_of

BEST = 10
#: Shares of the postings that the first tiers end at; the last tier has the rest.
SHARES = (0.1, 0.4)
#: Bytes of items searched at once (what a task holds of them); documents of an index block; items scored side by side; products made at once.
BLOCK_BYTES, BLOCK_DOCS, GROUP, PRODUCTS = 16 << 20, 512, 256, 1 << 20
#: Histogram bins for each doubling of the impact.
FINE = 16


@dataclass
class Items:
    """The items' distinct terms by hash, and for each term the items that hold it and how often."""

    terms: np.ndarray
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: list[str | None]) -> Items:
        words = Words(*text_buffers(pa.array(texts, pa.large_string())))
        terms, place = np.unique(words.hash, return_inverse=True)
        item = np.repeat(np.arange(len(texts)), np.diff(words.at))
        key, times = np.unique(item * max(1, len(terms)) + place, return_counts=True)
        return cls(terms, key // max(1, len(terms)), key % max(1, len(terms)), times, len(texts))

    def groups(self, active: np.ndarray) -> Iterator[Group]:
        for low in range(0, len(active), GROUP):
            yield Group(self, active[low : low + GROUP])


class Group:
    """Some items, by term."""

    def __init__(self, items: Items, mine: np.ndarray):
        self.mine, self.n = mine, len(mine)
        place = np.full(items.n, -1)
        place[mine] = np.arange(len(mine))
        keep = np.flatnonzero(place[items.item] >= 0)
        keep = keep[np.argsort(items.term[keep], kind="stable")]
        self.item, self.term, self.times = place[items.item[keep]], items.term[keep], items.times[keep]
        self.count = np.bincount(self.term, minlength=len(items.terms))
        self.first = np.cumsum(self.count) - self.count
        self.most = int(np.bincount(self.item, minlength=self.n).max(initial=0))

    def bound(self, residual: np.ndarray) -> np.ndarray:
        """What all terms of an item can add together."""
        return _sums(self.item, residual[self.term] * self.times, self.n, len(self.term))

    def sums(self, docs: int, doc: np.ndarray, term: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        """For each of `values` (one a posting) its sums by document and item, whole numbers."""
        out = [np.zeros(docs * self.n, np.int64) for _ in values]
        count = self.count[term]
        ends = np.cumsum(count)
        low = 0
        while low < len(doc):
            done = ends[low] - count[low]
            high = max(low + 1, int(np.searchsorted(ends, done + PRODUCTS, "right")))
            some = count[low:high]
            posting = np.repeat(np.arange(low, high), some)
            entry = np.arange(len(posting)) - np.repeat(np.cumsum(some) - some, some) + self.first[term[posting]]
            key = doc[posting] * self.n + self.item[entry]
            for x, total in zip(values, out, strict=True):
                total += _sums(key, x[posting] * self.times[entry], len(total), self.most)
            low = high
        return [x.reshape(docs, self.n) for x in out]


def _sums(key: np.ndarray, value: np.ndarray, size: int, most: int) -> np.ndarray:
    """Sums by key of whole numbers >= 0; a key has `most` values at most."""
    if not len(key):
        return np.zeros(size, np.int64)
    if int(value.max()) * most < 1 << 53:
        return np.bincount(key, value, size).astype(np.int64)
    halves = (np.bincount(key, part, size).astype(np.int64) for part in (value >> 24, value & 0xFFFFFF))
    return (next(halves) << 24) + next(halves)


def _count(items_of):
    """A row a block: how many documents have terms and how many terms, and the postings of the items' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items_of.value.terms
        for batch in batches:
            for piece in pieces(batch, "txt", 1 << 20):
                for low in range(0, piece.num_rows, BLOCK_DOCS):
                    part = piece.slice(low, BLOCK_DOCS)
                    words = Words(*text_buffers(part.column(1)))
                    n = np.diff(words.at)
                    at = np.minimum(np.searchsorted(known, words.hash), max(0, len(known) - 1))
                    held = np.flatnonzero(known[at] == words.hash) if len(known) else np.empty(0, np.int64)
                    key, tf = np.unique(np.repeat(np.arange(len(n)), n)[held] * max(1, len(known)) + at[held], return_counts=True)
                    doc, term = np.divmod(key, max(1, len(known)))
                    used, place = np.unique(doc, return_inverse=True)
                    ids = pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), part.column(0).take(pa.array(used)))
                    numbers = [n[used], place, term, tf]
                    yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())]), ids, *(pa.array([x.astype(np.int64).astype(kind).tobytes()], pa.binary()) for x, kind in zip(numbers, ("i8", "i4", "i4", "i4"), strict=True))], names=["docs", "terms", "ids", "n", "doc", "term", "tf"])

    return run


def _frequencies(size: int):
    """(term, documents) of a task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_py(), np.int32), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["term", "n"])

    return run


@dataclass
class Scale:
    """The whole corpus's documents and terms, and each term's weight."""

    docs: int
    terms: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        if len(n) and 75 * int(n.max()) * self.docs < 1 << 63:
            m = 25 + 75 * n * self.docs // self.terms
        else:
            m = np.array([25 + 75 * int(x) * self.docs // self.terms for x in n], np.int64)
        tf = tf.astype(np.int64)
        return self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


def _arrays(row: dict, *names: tuple[str, str]) -> list[np.ndarray]:
    return [np.frombuffer(row[name] or b"", kind) for name, kind in names]


def _spread(scale_of, size: int):
    """(kind, key, value) of a task's postings: 0, impact bin, count; 1, term, largest impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, most = np.zeros(64 * FINE, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                n, doc, term, tf = _arrays(row, ("n", "i8"), ("doc", "i4"), ("term", "i4"), ("tf", "i4"))
                impact = scale_of.value.impacts(n, doc, term, tf)
                bins += np.bincount(_bin(impact), minlength=len(bins))
                np.maximum.at(most, term, impact)
        a, b = np.flatnonzero(bins), np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [len(a), len(b)])), pa.array(np.concatenate([a, b])), pa.array(np.concatenate([bins[a], most[b]]))], names=["kind", "key", "value"])

    return run


def _bin(impact: np.ndarray) -> np.ndarray:
    return (np.log2(np.maximum(impact, 1)) * FINE).astype(np.int64)


def _least(bins: dict[int, int], shares: tuple[float, ...]) -> list[int]:
    """The bin that each tier but the last begins at, so that about a share of all postings lies in it and the tiers before."""
    total, out, seen = sum(bins.values()), [], 0
    for b in sorted(bins, reverse=True):
        seen += bins[b]
        while len(out) < len(shares) and seen >= shares[len(out)] * total:
            out.append(b)
    return out + [0] * (len(shares) - len(out))


def _index(scale_of, least: list[int]):
    """Blocks with a column a tier for document, term and impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["n", "doc", "term", "tf"]).to_pylist()):
                n, doc, term, tf = _arrays(row, ("n", "i8"), ("doc", "i4"), ("term", "i4"), ("tf", "i4"))
                impact = scale_of.value.impacts(n, doc, term, tf)
                # the first tier whose least bin the impact reaches
                tier = (_bin(impact)[:, None] < np.array(least)[None, :]).sum(1) if len(impact) else np.empty(0, np.int64)
                out = {"ids": batch.column(batch.schema.get_field_index("ids")).slice(i, 1)}
                for k in range(len(least) + 1):
                    at = np.flatnonzero(tier == k)
                    out |= {f"doc{k}": pa.array([doc[at].tobytes()], pa.binary()), f"term{k}": pa.array([term[at].tobytes()], pa.binary()), f"impact{k}": pa.array([impact[at].tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _tiers(row: dict, tiers: range) -> list[np.ndarray]:
    """doc, term and impact of a block's postings in some tiers."""
    found = [_arrays(row, (f"doc{k}", "i4"), (f"term{k}", "i4"), (f"impact{k}", "i8")) for k in tiers]
    return [np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, dict]]:
    """Each block's document ids, and its other columns."""
    rest = batch.select([name for name in batch.schema.names if name != "ids"]).to_pylist()
    for ids, row in zip(batch.column(batch.schema.get_field_index("ids")), rest, strict=True):
        yield ids.values, row


class _Running:
    """Scores that may still be among an item's best of a task: those from the task's BEST-th on."""

    def __init__(self, n: int, start: np.ndarray | None = None):
        self.best = np.zeros((n, BEST), np.int64)
        self.mark = np.ones(n, np.int64) if start is None else np.maximum(start, 1)

    def pick(self, items: np.ndarray, scores: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score) of a block's BEST by score and place in `order`, if they reach the mark."""
        ranked = scores[order]
        top = np.argsort(-ranked, axis=0, kind="stable")[:BEST]
        value = np.take_along_axis(ranked, top, 0)
        keep = value >= self.mark[items][None, :]
        # the few largest of a sorted row of BEST and the new ones
        merged = np.sort(np.concatenate([self.best[items], np.where(keep, value, 0).T], axis=1), axis=1)[:, -BEST:]
        self.best[items] = merged
        self.mark[items] = np.maximum(self.mark[items], merged[:, 0])
        rank, column = np.nonzero(keep)
        return items[column], order[top[rank, column]], value[rank, column]


def _rows(ids: pa.Array, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    item, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int64)), ids.take(pa.array(doc)), pa.array(score)], names=["item", "id", "score"])


def _order(ids: pa.Array) -> np.ndarray:
    """Places of a block's documents by id, nulls last."""
    return pc.array_sort_indices(ids, order="ascending", null_placement="at_end").to_numpy().astype(np.int64)


def _partial(items_of, active: np.ndarray, tiers: int):
    """A task's best by the first `tiers` tiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_of.value
        running, groups = _Running(items.n), list(items.groups(active))
        for batch in batches:
            for ids, row in _blocks(batch):
                doc, term, impact = _tiers(row, range(tiers))
                order, found = _order(ids), []
                for g in groups:
                    found.append(running.pick(g.mine, g.sums(len(ids), doc, term, [impact])[0], order))
                yield _rows(ids, found)

    return run


def _completed(items_of, active: np.ndarray, mark: np.ndarray, residual: np.ndarray, tiers: int, all_tiers: int):
    """Whole scores of the documents that the bounds leave for proven items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = items_of.value
        running, groups = _Running(items.n, mark), list(items.groups(active))
        bounds = [g.bound(residual) for g in groups]
        for batch in batches:
            for ids, row in _blocks(batch):
                doc, term, impact = _tiers(row, range(tiers))
                low_doc, low_term, low_impact = _tiers(row, range(tiers, all_tiers))
                order, found = _order(ids), []
                for g, bound in zip(groups, bounds, strict=True):
                    seen, spent = g.sums(len(ids), doc, term, [impact, residual[term]])
                    left = seen + bound[None, :] - spent >= mark[g.mine][None, :]
                    if not left.any():
                        continue
                    wanted = left.any(1)[low_doc]
                    rest = g.sums(len(ids), low_doc[wanted], low_term[wanted], [low_impact[wanted]])[0]
                    found.append(running.pick(g.mine, np.where(left, seen + rest, 0), order))
                if found:
                    yield _rows(ids, found)

    return run


def _best(found: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= BEST)


class Index:
    """The tiered index of all documents for some items' terms."""

    def __init__(self, docs: DataFrame, items: Items, shares: tuple[float, ...] = SHARES):
        spark = docs.sparkSession
        self.items, self.shared, size = items, spark.sparkContext.broadcast(items), max(1, len(items.terms))
        self.id_type = docs.schema["id"].dataType.simpleString()
        postings, _ = saved(docs.mapInArrow(_count(self.shared), f"docs long, terms long, ids array<{self.id_type}>, n binary, doc binary, term binary, tf binary"), "postings")
        totals = postings.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("terms"), F.lit(0)).alias("t")).first()
        weights = np.zeros(size, np.int64)
        for row in postings.select("term").mapInArrow(_frequencies(size), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            weights[row.term] = math.floor(1000 * math.log((2 * totals.d + 2) / (2 * row.n + 1)))
        scale = spark.sparkContext.broadcast(Scale(totals.d, max(1, totals.t), weights))
        numbers = postings.select("n", "doc", "term", "tf").mapInArrow(_spread(scale, size), "kind long, key long, value long")
        spread = numbers.groupBy("kind", "key").agg(F.sum("value").alias("total"), F.max("value").alias("most")).collect()  # the bins and the items' terms
        least = _least({r.key: r.total for r in spread if not r.kind}, shares)
        self.most = np.zeros(size, np.int64)
        for row in spread:
            if row.kind:
                self.most[row.key] = row.most
        # below a bin lie impacts under 2 ^ (bin / FINE)
        self.under = [math.ceil(2 ** (b / FINE)) for b in least]
        self.tiers = len(least) + 1
        columns = ", ".join(f"doc{k} binary, term{k} binary, impact{k} binary" for k in range(self.tiers))
        self.blocks, _ = saved(postings.select("ids", "n", "doc", "term", "tf").mapInArrow(_index(scale, least), f"ids array<{self.id_type}>, {columns}"), "tiers")

    def residual(self, tiers: int) -> np.ndarray:
        """What a posting of each term has at most below the first `tiers` tiers."""
        return np.minimum(self.most, self.under[tiers - 1]) if tiers < self.tiers else np.zeros_like(self.most)

    def _read(self, tiers: int) -> DataFrame:
        return self.blocks.select("ids", *(f"{c}{k}" for k in range(tiers) for c in ("doc", "term", "impact")))

    def search(self) -> tuple[DataFrame, list[int]]:
        """(item, id, score, rank) of all items, and how many items each tier proved."""
        schema = f"item long, id {self.id_type}, score long"
        active, out, proven = np.arange(self.items.n), None, []
        for tiers in range(1, self.tiers + 1):
            partial = _best(self._read(tiers).mapInArrow(_partial(self.shared, active, tiers), schema))
            if tiers == self.tiers:
                last, ended = partial, active
            else:
                mark = np.zeros(self.items.n, np.int64)
                for row in partial.filter(F.col("rank") == BEST).select("item", "score").collect():
                    mark[row.item] = row.score
                residual = self.residual(tiers)
                bound = np.zeros(self.items.n, np.int64)
                for g in self.items.groups(active):
                    bound[g.mine] = g.bound(residual)
                ended = active[bound[active] < mark[active]]
                active = active[bound[active] >= mark[active]]
                last = _best(self.blocks.mapInArrow(_completed(self.shared, ended, mark, residual, tiers, self.tiers), schema)) if len(ended) else None
            proven.append(len(ended))
            if last is not None:
                last, _ = saved(last, "ranked")
                out = last if out is None else out.unionByName(last)
            if not len(active):
                break
        return out, proven


def search(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", shares: tuple[float, ...] = SHARES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each item's BEST highest-scoring documents: item, rank (from 1), doc, score; equal scores by ascending doc, nulls last.

    Null and empty texts have no terms: such documents don't count and such items have no rows; documents without any
    of an item's terms, or whose terms weigh nothing, are no results. Repeated documents are documents each; of rows that repeat an item and its text one counts.
    An empty table on either side gives no rows. Other columns are ignored. The items are held by every task, BLOCK_BYTES
    of them at once (a larger table is searched block after block).
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    asked = items.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{item_text}`").alias("txt")).filter("txt is not null").distinct()
    item_type = asked.schema["item_id"].dataType.simpleString()
    out = None
    for block in blocks_of(asked, block_bytes):
        rows = block.collect()
        known = Items.of([r.txt for r in rows])
        if not len(known.terms):
            continue
        found, _ = Index(slim, known, shares).search()
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {item_type}")  # one block's items
        named = found.join(F.broadcast(names), "item").select(F.col("item_id").alias(item), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc), "score")
        out = named if out is None else out.unionByName(named)
    if out is None:
        return spark.createDataFrame([], f"`{item}` {item_type}, rank int, `{doc}` {slim.schema['id'].dataType.simpleString()}, score long")
    return out
