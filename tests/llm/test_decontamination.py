from __future__ import annotations

import hashlib
import re
import time
from collections import Counter

import numpy as np

from tests.llm.conftest import sentence
from textquarry.llm import decontamination
from textquarry.llm.decontamination import blocks, decontaminate, gram_words, uncontaminated
from textquarry.llm.words import Words

ITEMS = "item_id long, text string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, items):
    grams = {}
    for i, t in items:
        w = words(t)
        m = min(len(w), 10)
        for k in range(len(w) - m + 1) if w and i is not None else ():
            grams.setdefault((m, tuple(w[k : k + m])), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for m in {m for m, _ in grams}:
            for k in range(len(w) - m + 1):
                if own := grams.get((m, tuple(w[k : k + m]))):
                    found |= own
                    hit |= set(range(k, k + m))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_grams_cover_every_window():
    assert all(k + w - 1 == m for m in range(1, 11) for k, w in [gram_words(m)])


def test_equals_all_windows(spark, odd):
    base = sentence(1, 60).split()
    items = [(1, " ".join(base[5:17])), (2, " ".join(base[20:30]).upper()), (3, "x"), (30, "changed END"), (4, None), (5, ""), (6, "no such words"), (7, sentence(9, 30_000)[1000:1200]), (7, "x"), (None, "x"), (8, "漢字"), (9, "a" * 200_000), (10, " ".join(base[11:20]))]
    bench = spark.createDataFrame(items, ITEMS)
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], items)
    for size in (32 << 20, 300):  # in one broadcast block and in many
        got = sorted((tuple(r) for r in decontaminate(odd, bench, keep=["doc_id"], block_bytes=size).collect()), key=repr)
        assert got == want
    left = uncontaminated(odd, bench)
    assert left.columns == odd.columns
    assert left.count() == sum(not r[5] for r in want)


def test_an_item_beyond_a_block_is_cut(spark):
    """One item of many blocks' size: pieces keep every window, and no block collects more than its bound."""
    long = sentence(77, 4000)
    w = long.split()
    items = [(1, long), (2, sentence(78, 30)), (3, "just three words")]
    bench = spark.createDataFrame(items, ITEMS)
    held = [sum(len(t) for _, t in b) for _, b in blocks(bench, "item_id", "text", 8 << 10)]
    assert len(held) > 4 and max(held) <= 8 << 10
    rows = [(i, " ".join(w[i * 40 : i * 40 + 10 + i % 3])) for i in range(99)] + [(200, long), (201, sentence(79, 50)), (202, "only just three words more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in decontaminate(docs, bench, keep=["doc_id"], block_bytes=8 << 10).collect()), key=repr)
    assert got == brute(rows, items) and sum(r[5] for r in got) == 101


def test_empty(spark, odd, none):
    assert decontaminate(none, spark.createDataFrame([(1, "a b")], ITEMS), keep=["doc_id"]).count() == 0
    assert not any(r.contaminated for r in decontaminate(odd, spark.createDataFrame([], ITEMS), keep=["doc_id"]).collect())


def test_repeated_words_cost_a_comparison_a_place(spark):
    index = decontamination.ItemIndex([("a", "again " * 100_000), ("b", "again " * 50), ("c", "again again"), ("d", "other again again")])
    raw = np.frombuffer(("again " * 100_000).encode(), np.uint8)
    began = time.perf_counter()
    hits = list(index.hits(Words(raw, np.array([0, len(raw)]))))
    assert time.perf_counter() - began < 5
    assert sorted(Counter(m for _, _, m in hits).items()) == [(2, 99_999), (10, 99_991)]
    docs = spark.createDataFrame([(1, "again " * 3_000), (2, "again " * 9), (3, "once again"), (4, "x other again again y")], "doc_id long, text string")
    items = spark.createDataFrame([("a", "again " * 2_000), ("b", "again " * 50), ("c", "again again"), ("d", "other again again")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, items, keep=["doc_id"]).collect()}
    assert got == {1: (3_000, 3), 2: (9, 1), 3: (0, 0), 4: (3, 2)}
