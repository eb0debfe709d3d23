"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic and one on windows of ordinary labelled texts. A window is
WIDTH consecutive words, lower-cased; a word longer than WINDOW bytes counts as several that overlap by more than a stem. Windows are spelled out in 4-byte codes of their words' character trigrams before they are compressed: in
plain letters a word's match saves less than zstandard's own framing costs, in codes a shared stem of a few letters is a
long match and unknown letters are dear.

Most of a toxic text is ordinary, so dictionaries of all windows hardly differ. They are therefore trained in rounds, each on
the windows that the dictionaries of the round before find most toxic: of every text, toxic or ordinary, the PICKED
windows that the toxic dictionary shortens most against the ordinary one. What toxic texts share sharpens the one; what
ordinary texts have like it sharpens the other, along with usual windows. Nothing but compressed lengths chooses.

The difference of a window's two compressed lengths is then, for each length,  looked up in calibrated thresholds: log
ratios of how many toxic and ordinary documents, none of them used for the dictionaries, have a window like it. A document's
score is a logistic function of its two highest log ratios, so it depends on all windows of the whole text and not on its
length.

Fitted on a bounded sample of labelled rows (TOXIC and ORDINARY documents at most, smallest id hashes first); probabilities
are corrected for the sample's share of toxic rows.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import fold, saved
from textquarry.llm.words import pieces

#: Labelled documents of each class that a model is fitted on, at most; one in CALIBRATES doesn't train but calibrates.
TOXIC, ORDINARY, CALIBRATES = 4_000, 12_000, 4
TOXIC_BYTES, ORDINARY_BYTES, LEVEL, THRESHOLD = 16_384, 65_536, 6, 0.3
#: Words of a window (one: windows come again and their lengths are remembered); bytes of a piece of a long word, and its overlap with the next.
WIDTH, WINDOW, OVERLAP = 1, 16, 12
#: Training rounds, windows picked from a text in each, and windows of a text that the first dictionaries are trained on.
ROUNDS, PICKED, FIRST = 4, 3, 16
#: Windows whose lengths a worker remembers.
CACHE = 400_000
#: More than any compressed length: a window has at most WIDTH * WINDOW codes of 4 bytes, and framing.
LENGTHS = 64 * WIDTH * WINDOW

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    """The words of a whole text in order, long ones in pieces."""
    found = WORD.findall(text.lower().encode("utf-8", "replace"))
    if not found or max(map(len, found)) <= WINDOW:
        return found
    return [w[i : i + WINDOW] for w in found for i in (range(0, max(1, len(w) - OVERLAP), WINDOW - OVERLAP) if len(w) > WINDOW else (0,))]


def windows(text: str, width: int = WIDTH) -> set[bytes]:
    """The distinct windows of a whole text, words joined by blanks; a text of fewer words is one."""
    found = words(text)
    if width == 1 or not found:
        return set(found)
    return set(map(b" ".join, zip(*(found[i:] for i in range(width)), strict=False))) or {b" ".join(found)}


_CODES: dict[bytes, bytes] = {}


def spelled(window: bytes) -> bytes:
    """4-byte codes of the trigrams of ^word$, for each word."""
    out = []
    for word in window.split(b" "):
        w = b"^" + word + b"$"
        for i in range(len(w) - 2):
            g = w[i : i + 3]
            if (code := _CODES.get(g)) is None:
                if len(_CODES) > 200_000:
                    _CODES.clear()
                code = _CODES[g] = struct.pack("<I", zlib.crc32(g) * 2654435761 & 0xFFFFFFFF)
            out.append(code)
    return b"".join(out)


def dictionary(samples: Iterable[bytes], size: int) -> bytes:
    """A dictionary of spelled-out windows; all of them where they fit. Where training finds too little that repeats, the
    windows that come most often, each once, those that come most often last: zstandard reaches the end of a dictionary cheapest."""
    samples = sorted(samples)
    often = Counter(samples).most_common()
    random.Random(11).shuffle(samples)
    grouped = [b"".join(samples[i : i + 4]) for i in range(0, len(samples), 4)]
    if sum(map(len, grouped)) <= size:
        return b"".join(grouped)
    try:
        return zstandard.train_dictionary(size, grouped, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        fits = np.searchsorted(np.cumsum([len(w) for w, _ in often]), size, "right")
        return b"".join(w for w, _ in reversed(often[:fits]))


class Lengths:
    """Compressed lengths of windows with either dictionary, as a key: their difference and the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=4)
        self.compressors = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if d else None, compression_params=parameters) for d in (toxic, ordinary)]
        self.cache: dict[bytes, int] = {}

    def learn(self, wanted: set[bytes]) -> None:
        """Puts the keys of `wanted` into the cache."""
        if len(self.cache) + len(wanted) > CACHE:
            self.cache.clear()
        missing = [w for w in wanted if w not in self.cache]
        for low in range(0, len(missing), 20_000):
            part = missing[low : low + 20_000]
            raw = list(map(spelled, part))
            both = []
            for c in self.compressors:
                out = c.multi_compress_to_buffer(raw, threads=0)
                both.append([len(out[i]) for i in range(len(out))])
            self.cache.update((w, (o - t) * LENGTHS + o) for w, t, o in zip(part, *both, strict=True))

    def windows_of(self, texts: list[str | None]) -> Iterator[set[bytes]]:
        """Each text's windows, their keys being learnt."""
        found = [windows(t or "") for t in texts]
        for low in range(0, len(found), 256):
            part = found[low : low + 256]
            self.learn(set().union(*part))
            yield from part

    def keys_of(self, texts: list[str | None]) -> Iterator[set[int]]:
        for ws in self.windows_of(texts):
            yield set(map(self.cache.__getitem__, ws))


def difference(key: int) -> int:
    """By how much the toxic dictionary shortens a window more."""
    return key // LENGTHS


@dataclass
class ToxicModel:
    toxic: bytes
    ordinary: bytes
    ratios: dict[int, float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    @property
    def name(self) -> str:
        return hashlib.sha256(len(self.toxic).to_bytes(8, "big") + self.toxic + self.ordinary).hexdigest()

    def features(self, keys: set[int]) -> tuple[float, float]:
        """The highest and the second highest log ratio."""
        best = sorted((self.ratios.get(k, 0.0) for k in keys), reverse=True)[:2] + [0.0, 0.0]
        return best[0], best[1]

    def score(self, keys: set[int]) -> float:
        a, b = self.features(keys)
        w = self.weights
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] + w[1] * a + w[2] * b))))


_LENGTHS: dict[str, Lengths] = {}


def _lengths(model: ToxicModel) -> Lengths:
    if model.name not in _LENGTHS:
        _LENGTHS.clear()
        _LENGTHS[model.name] = Lengths(model.toxic, model.ordinary)
    return _LENGTHS[model.name]


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FIRST windows of each text, at random: their hashes differ from text to text, so frequent windows come often."""
    for batch in (part for whole in batches for part in pieces(whole, "txt")):
        chosen, toxic = [], []
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seed = zlib.crc32((text or "").encode("utf-8", "replace"))
            some = [spelled(w) for w in sorted(windows(text or ""), key=lambda w: (zlib.crc32(w, seed), w))[:FIRST]]
            chosen += some
            toxic += [y] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(chosen, pa.binary())], names=["y", "spelled"])


def _picked(model_of):
    """The PICKED windows of each text that the toxic dictionary shortens most, if it does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model_of.value)
        for batch in (part for whole in batches for part in pieces(whole, "txt")):
            chosen, toxic = [], []
            for ws, y in zip(lengths.windows_of(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True):
                some = sorted((-difference(k), w) for w in ws if difference(k := lengths.cache[w]) > 0)[:PICKED]
                chosen += [spelled(w) for _, w in some]
                toxic += [y] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(chosen, pa.binary())], names=["y", "spelled"])

    return run


def _key_rows(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model_of.value)
        for batch in (part for whole in batches for part in pieces(whole, "txt")):
            keys = [sorted(k) for k in lengths.keys_of(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys, pa.list_(pa.int32()))], names=["y", "keys"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (constant first) by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (y - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(model: ToxicModel, rows: list[tuple[int, list[int]]], toxic: int, ordinary: int) -> ToxicModel:
    """Log ratios by key and the logistic weights; toxic, ordinary: labelled rows of each class before sampling."""
    positive, negative = [set(k) for y, k in rows if y], [set(k) for y, k in rows if not y]
    if not positive or not negative:
        rate = (toxic + 1) / (toxic + ordinary + 2)
        return ToxicModel(model.toxic, model.ordinary, {}, (math.log(rate / (1 - rate)), 0.0, 0.0))
    in_toxic, in_ordinary = Counter(k for ks in positive for k in ks), Counter(k for ks in negative for k in ks)
    ratios = {k: math.log((in_toxic[k] + 0.2) / (len(positive) + 1)) - math.log((in_ordinary[k] + 2.0) / (len(negative) + 1)) for k in in_toxic | in_ordinary}
    out = ToxicModel(model.toxic, model.ordinary, ratios)
    x = np.array([out.features(set(k)) for _, k in rows])
    y = np.array([float(v > 0) for v, _ in rows])
    w = _logistic(x, y)
    w[0] -= math.log(len(positive) / len(negative)) - math.log(max(toxic, 1) / max(ordinary, 1))
    out.weights = tuple(float(v) for v in w)
    return out


def dictionaries(sample: DataFrame) -> ToxicModel:
    """The two dictionaries from (txt, y), in rounds. The driver sees FIRST or PICKED windows of each text, WINDOW * WIDTH codes long at most."""
    context = sample.sparkSession.sparkContext

    def windows_of(run) -> tuple[list[bytes], list[bytes]]:
        rows = sample.mapInArrow(run, "y int, spelled binary").collect()
        return [bytes(r[1]) for r in rows if r[0]], [bytes(r[1]) for r in rows if not r[0]]

    toxic, usual = map(sorted, windows_of(_first))
    model = ToxicModel(dictionary(toxic, TOXIC_BYTES), dictionary(usual, ORDINARY_BYTES))
    for _ in range(ROUNDS):
        toxic, like = windows_of(_picked(context.broadcast(model)))
        some = random.Random(5).sample(usual, min(len(usual), 3 * len(like)))
        model = ToxicModel(dictionary(toxic, TOXIC_BYTES), dictionary([*like, *some], ORDINARY_BYTES))
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 4, held: int = 2, doc: str = "doc_id", text: str = "text", most_toxic: int = TOXIC, most_ordinary: int = ORDINARY) -> ToxicModel:
    """Dictionaries from most of the sample, thresholds from the rest; of rows that repeat an id the sample has the smallest text."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & (fold(F.col(doc), folds) != held)).groupBy(F.col(doc).alias("id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["t"]: r["count"] for r in known.groupBy((F.col("y") > 0).alias("t")).count().collect()}
    order = [F.xxhash64("id"), F.col("id")]
    chosen = known.filter("y > 0").orderBy(*order).limit(most_toxic).unionByName(known.filter("y <= 0").orderBy(*order).limit(most_ordinary))
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    one = slim.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("txt").alias("txt"))
    sample, _ = saved(one.select("txt", (F.col("y") > 0).cast("int").alias("y"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(CALIBRATES)) == 0).alias("calibrates")), "toxic-sample")
    model = dictionaries(sample.filter("not calibrates").select("txt", "y"))
    rows = sample.filter("calibrates").select("txt", "y").mapInArrow(_key_rows(spark.sparkContext.broadcast(model)), "y int, keys array<int>").collect()
    return calibrated(model, [(r["y"], r["keys"]) for r in rows], sizes.get(True, 0), sizes.get(False, 0))


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: ToxicModel = model_of.value
        lengths = _lengths(model)
        for batch in batches:
            for part in pieces(batch, "txt"):
                scores = [model.score(k) for k in lengths.keys_of(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return run


def classified(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: int = 4, held: int = 2, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **bounds: int) -> DataFrame:
    """Per document: doc, held_out, score, predicted.

    Null and empty texts have no windows and score the constant. Several labels of one id count as their largest;
    without labels of both classes every score is the (smoothed) base rate. Repeated rows each get a row; language,
    source and other columns are never read. A null id counts as fold 0.
    """
    model = train(docs, labels, label=label, folds=folds, held=held, doc=doc, text=text, **bounds)
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    out = slim.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"id {slim.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(doc), (fold(F.col("id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
