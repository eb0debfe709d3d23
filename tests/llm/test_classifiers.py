from __future__ import annotations

import math
import zlib
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, sentence
from textquarry.llm import quality_classifier, toxicity
from textquarry.llm.quality_classifier import fitted, shallow_tree

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 5 == 0
        text = sentence(i, 40 + i % 30)
        if toxic:
            text = text.replace(" ", f" vorgish{i % 7} ", 2)
        if bad:
            text = "### | ".join(text.upper().split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS), {r[0]: r[1:] for r in labels}


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    for made, column, n, k in ((quality_classifier.classified(docs, labels), 0, 5, 0), (toxicity.classified(docs, labels), 1, 4, 2)):
        rows = made.collect()
        assert len(rows) == 240
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        held = [r for r in rows if r.held_out]
        assert sum(r.predicted == truth[r.doc_id][column] for r in held) >= 0.9 * len(held)


def test_both_classes_are_told_apart(spark):
    """A constant answer does not pass."""
    docs, labels, truth = corpus(spark, 1000)
    for made, column in ((quality_classifier.classified(docs, labels), 0), (toxicity.classified(docs, labels), 1)):
        held = made.filter("held_out").collect()
        for value in (0, 1):
            mine = [r for r in held if truth[r.doc_id][column] == value]
            assert sum(r.predicted == value for r in mine) >= 0.9 * len(mine)


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = corpus(spark)
    for classified, column, n, k in ((quality_classifier.classified, "quality", 5, 0), (toxicity.classified, "toxic", 4, 2)):
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == k
        flipped = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        assert {(r.doc_id, r.score) for r in classified(docs, labels).collect()} == {(r.doc_id, r.score) for r in classified(docs, flipped).collect()}


def test_odd_rows_and_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 1), (8, 1, 0), (99, 1, 1)], LABELS)
    empty = spark.createDataFrame([], LABELS)
    for op in (quality_classifier.classified, toxicity.classified):
        for found in (labels, empty):
            rows = op(odd, found).collect()
            assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert op(none, labels).count() == 0
    assert quality_classifier.kept(odd, labels).columns == odd.columns


def test_toxic_scores_by_hand(spark):
    """Scores from single compressions of all windows of whole texts, without caches, batches or sets."""
    docs, labels, _ = corpus(spark)
    model = toxicity.train(docs, labels)
    made = toxicity.Lengths(model.toxic, model.ordinary).compressors
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.classified(docs, labels).collect():
        seen, words = [], texts[r.doc_id].lower().encode().replace(b"|", b" ").replace(b"#", b" ").split()
        for word in words:
            raw = toxicity.spelled(word)
            t, o = (len(c.compress(raw)) for c in made)
            key = (o - t) * toxicity.LENGTHS + o
            seen.append((model.ratios.get(key, 0.0), key))
        best = [x for x, _ in sorted(set(seen), reverse=True)][:2] + [0.0, 0.0]
        z = model.weights[0] + model.weights[1] * best[0] + model.weights[2] * best[1]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_toxic_stems(spark):
    """A stem inside compounds of many lengths."""
    rows, labels = [], []
    for i in range(800):
        text = sentence(i, 50)
        if i % 8 == 0:
            text = text.replace(" ", f" blorgaz{'abcdefgh'[i // 8 % 8] * (i % 9)}tion ", 3)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    got = toxicity.classified(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).filter("held_out").collect()
    mine, clean = ([r.predicted for r in got if (r.doc_id % 8 == 0) is x] for x in (True, False))
    assert sum(mine) >= 0.75 * len(mine) and sum(clean) <= 0.05 * len(clean)


def test_windows_cover_whole_texts():
    text = "One two-three " + "x" * 40 + " é"
    assert [len(w) for w in toxicity.words(text)] == [3, 3, 5, 16, 16, 16, 16, 16, 16, 16, 2]
    assert toxicity.windows(text) == {b"one", b"two", b"three", b"x" * 16, "é".encode()}
    assert {b"one two", b"two three", b"three " + b"x" * 16} < toxicity.windows(text, 2)
    assert toxicity.windows("") == set() and toxicity.windows("One", 2) == {b"one"}


def test_tables_and_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)  # only a pair of features tells
    model = fitted(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    assert len(set(shallow_tree(rng.normal(size=32), np.ones(32)))) <= 4
    assert fitted(np.empty((0, 3)), np.empty(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_stems_in_long_words_are_whole_in_a_window():
    stem, rng = b"vorgishlaque", np.random.default_rng(3)
    for size in (5, 17, 40, 300):
        for at in range(0, size, 3):
            word = b"k" * at + stem + b"z" * (size - at)
            assert any(stem in w for w in toxicity.windows(word.decode()))
    lengths = toxicity.Lengths(b"", b"")
    odd = {bytes(rng.integers(97, 123, toxicity.WINDOW, dtype=np.uint8)) for _ in range(200)}
    lengths.learn(odd)
    sizes = [divmod(lengths.cache[w], toxicity.LENGTHS) for w in odd]  # the difference and the ordinary length
    assert all(toxicity.WINDOW * 4 <= o - d < toxicity.LENGTHS // 2 and o < toxicity.LENGTHS // 2 for d, o in sizes)


def test_rare_toxic_words_are_trained_on(spark):
    """A word in a few of some thousand toxic documents."""
    rows = [(i, f"{sentence(i, 4)} {'vorgishna' if i % 2 else ''} {'qablixtor' if i % 401 == 0 and i % 2 else ''}", "en", "s", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(6000)], LABELS)
    assert toxicity.spelled(b"qablixtor")[4:-4] in toxicity.train(docs, labels).toxic


def test_quality_scores_as_plain_sums_of_table_entries(spark):
    """The whole query against every row's bins looked up one by one."""
    docs, labels, _ = corpus(spark)
    model = quality_classifier.train(docs, labels)
    assert any(np.abs(t).max() > 0 for t in model.tables) and any(np.abs(t).max() > 0 for t in model.pairs.values())
    expected = {}
    for row in quality_classifier.features(docs, [F.col("doc_id")], F.col("text")).collect():
        x = [row[f] for f in quality_classifier.FEATURES]
        z = model.intercept + sum(float(t[bisect_right(list(e), v)]) for e, t, v in zip(model.edges, model.tables, x, strict=True))
        for (i, j), t in model.pairs.items():
            z += float(t[bisect_right(list(model.pair_edges[i]), x[i]), bisect_right(list(model.pair_edges[j]), x[j])])
        expected[row.doc_id] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    got = quality_classifier.classified(docs, labels).collect()
    assert len(got) == docs.count() == len(expected)
    for row in got:
        assert row.score == pytest.approx(expected[row.doc_id], abs=1e-12) and row.predicted == int(row.score >= 0.3)
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_a_dictionary_without_training_has_the_most_frequent_windows():
    samples = [bytes([i, i + 1]) * 20 for i in range(12)]
    assert toxicity.dictionary([*samples, samples[7], samples[3], samples[3]], 100) == samples[7] + samples[3]
    assert len(toxicity.dictionary(samples[:2], 400)) == 80
