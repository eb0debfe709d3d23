"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted feature by feature in turn, end up as one lookup table a feature (and one a chosen pair): training
adds each tree's leaves to the table's bins, and a score is the sum of one entry from each table. Features are one Spark
projection of the whole text; scoring reads bins for a batch at a time and adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textquarry.llm.common import fold
from textquarry.llm.quality_rules import base_measures, more_measures, ratios

#: Labelled rows that a model is fitted on, at most: those whose ids have the smallest hashes.
SAMPLE = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 32, 8, 6, 80, 40, 0.15, 2.0

FEATURES = [
    "n_words", "n_lines", "mean_word_chars", "symbol_share", "bar_share", "upper_share", "exclamation_share", "dup_line_share",
    "repeat_share", "max_word_share", "stop_share", "digit_share", "stop_mark_share", "bullet_line_share", "words_a_line",
]


def features(docs: DataFrame, keep: list[Column], text: Column) -> DataFrame:
    """keep and FEATURES (double) of whole texts; null and empty texts have zeros."""
    counted = docs.select(*keep, *[c.alias(n) for n, c in {**base_measures(text), **more_measures(text)}.items()])

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    made = {
        **ratios(),
        "repeat_share": share("n_repeat_words", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
        "stop_mark_share": share("n_stops", "n_words"),
        "words_a_line": share("n_words", "n_lines"),
    }
    names = [c for c in counted.columns if c not in {**base_measures(text), **more_measures(text)}]
    return counted.withColumns(made).select(*names, *[F.col(f).cast("double").alias(f) for f in FEATURES])


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of rows of features: bins, then table entries added."""
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], "right")]
        if self.pairs:
            bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (i, j), table in self.pairs.items():
                z += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    if not len(x):
        return np.empty(0)
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values over ordered bins of a tree of that depth."""
    gain, at = _cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])


def shallow_pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over a grid: one cut of the rows and one of the columns in each half.

    The rows are cut where the halves' own column cuts gain most: where two features only tell together, the rows'
    sums alone tell nothing.
    """

    def gain(part: slice) -> float:
        return _cut(g[part].sum(0), h[part].sum(0))[0] + g[part].sum() ** 2 / (h[part].sum() + RIDGE)

    at = max(range(1, len(g)), key=lambda i: gain(slice(0, i)) + gain(slice(i, None)), default=0)
    halves = [np.tile(shallow_tree(g[part].sum(0), h[part].sum(0), 1), (len(g[part]), 1)) for part in (slice(0, at), slice(at, None)) if len(g[part])]
    return np.concatenate(halves)


def fitted(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Deterministic; without rows, or rows of one class, the model is the (smoothed) base rate."""
    n, width = x.shape
    rate = (y.sum() + 1) / (n + 2)
    edges = [_edges(x[:, j], BINS) for j in range(width)]
    model = AdditiveModel(float(np.log(rate / (1 - rate))), edges, [np.zeros(len(e) + 1) for e in edges])
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    z = np.full(n, model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return y - p, p * (1 - p) + 1e-9

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            size = len(edges[j]) + 1
            step = RATE * shallow_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
            model.tables[j] += step
            z += step[bins[j]]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], v, a * b).reshape(a, b)

    g, h = slopes()
    gains = {(i, j): float((grid(i, j, g) ** 2 / (grid(i, j, h) + RIDGE)).sum()) for i, j in combinations(range(width), 2)}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]:
        model.pairs[pair] = np.zeros(grid(*pair, g).shape)
    for _ in range(PAIR_ROUNDS):
        for (i, j), tab in model.pairs.items():
            g, h = slopes()
            step = RATE * shallow_pair_tree(grid(i, j, g), grid(i, j, h))
            tab += step
            z += step[coarse[i], coarse[j]]
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, doc: str, text: str, most: int) -> DataFrame:
    """id, txt, y of at most `most` labelled documents outside the held-out fold: the smallest hashes of ids.

    Several labels of one id count as their largest. At most `most` label rows are broadcast, so the documents aren't
    shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & (fold(F.col(doc), folds) != held)).groupBy(F.col(doc).alias("id")).agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(most)
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    return slim.join(F.broadcast(chosen), "id")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held: int = 0, doc: str = "doc_id", text: str = "text", most: int = SAMPLE) -> AdditiveModel:
    sample = labelled_sample(docs, labels, label, folds, held, doc, text, most)
    made = features(sample, [F.col("id"), F.col("y")], F.col("txt"))
    rows = made.orderBy(F.xxhash64("id"), *FEATURES, "y").limit(most).toPandas()
    return fitted(rows[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), rows["y"].to_numpy(float))


def _score(model_of, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: AdditiveModel = model_of.value
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x = np.column_stack([column[f].to_numpy(zero_copy_only=False) for f in FEATURES]) if batch.num_rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_pydict({k: column[k] for k in keep} | {"score": pa.array(model.score(x))})

    return run


def scored(docs: DataFrame, model: AdditiveModel, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and score."""
    made = features(docs, [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`"))
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*(made.schema[n] for n in names), T.StructField("score", T.DoubleType())])
    out = made.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), names), schema)
    return out.toDF(*keep, "score")


def classified(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held: int = 0, doc: str = "doc_id", text: str = "text", most: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc, held_out, score, predicted.

    Null texts score as empty ones; repeated rows each get a row; other columns, language and source among them, are
    never read. A null id counts as fold 0.
    """
    out = scored(docs, train(docs, labels, label=label, folds=folds, held=held, doc=doc, text=text, most=most), [doc], text)
    return out.select(doc, (fold(F.col(doc), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents not rejected, with all their columns."""
    model = train(docs, labels, doc=doc, text=text)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("txt"))
    return scored(whole, model, ["row"], "txt").filter(F.col("score") >= threshold).select("row.*")
