from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from textquarry.llm import substrings
from textquarry.llm.substrings import anchors, deduplicated, rolled, split, word_hashes

DOCS = "doc_id long, text string, digest int, windows int, key string"


def brute(rows, window):
    """(doc_id, n_words, n_removed, kept_sha256) by a dictionary of all windows."""
    first, split_rows = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split_rows:
        for i in range(len(w) - window + 1):
            key, at = tuple(w[i : i + window]), (d is None, d or 0, i)
            first[key] = min(first.get(key, at), at)
    out = []
    for d, w in split_rows:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d is None, d or 0, i):
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(d, t, 1, 2, "k") for d, t in rows], DOCS).repartition(parts)


def passages(seed, n, size=40):
    """Texts that share passages, some with copies."""
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    shared = [[rnd.choice(words) for _ in range(rnd.randrange(3, size))] for _ in range(6)]
    out = []
    for i in range(n):
        text = []
        for _ in range(rnd.randrange(1, 4)):
            text += rnd.choice(shared) if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randrange(30))]
        out.append((i, rnd.choice([" ", "\n", "\t "]).join(text)))
    return out


@pytest.mark.parametrize("window", [1, 6, 20])
def test_as_brute_force(spark, window):
    rows = passages(window, 120) + [(500 + i, passages(window, 120)[3][1]) for i in range(60)]  # a third are copies
    assert rows_of(deduplicated(frame(spark, rows), window=window, gram=min(5, window), bucket_bytes=2000)) == brute(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 1000} x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (5, "same " * 300), (5, "same " * 300), (6, long), (7, "begin " + long), (None, long), (None, long), (None, "other " * 40)]
    rows += [(8, "p " + " ".join(f"q{i}" for i in range(40))), (8, "r " + " ".join(f"q{i}" for i in range(40))), (9, "Q " + " ".join(f"Q{i}" for i in range(40))), (10, "é漢🙂 " * 30), (11, "z" * 200_000)]
    got = deduplicated(frame(spark, rows))
    assert rows_of(got) == brute(rows, 20)
    assert {r.doc_id: r.spans for r in got.collect() if r.doc_id in (4, 5, 7)} == {4: [], 5: [[1, 300]], 7: [[1, 60_001]]}
    assert deduplicated(frame(spark, rows).limit(0)).collect() == []


def test_many_rows_of_one_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text)] * 700 + [(1, text)] + [(i, f"doc {i}") for i in range(2, 1500)]
    assert rows_of(deduplicated(frame(spark, rows))) == brute(rows, 20)


def test_pieces_of_a_long_text_and_rolling_hashes(monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT_BYTES", 50)
    raw = (" a  bb\tccc\n" * 100 + "d" * 500 + " e").encode()
    assert [w for some in split(raw) for w in some] == raw.split()
    hashes = word_hashes(raw)
    plain = [sum(int(h) * substrings.BASE**t for t, h in enumerate(hashes[i : i + 7])) % 2**64 for i in range(len(hashes) - 6)]
    assert rolled(hashes, 7, substrings.BASE).tolist() == substrings.mixed(np.array(plain, np.uint64)).tolist()
    grams = rolled(hashes, 5, substrings.GRAM_BASE)
    assert anchors(hashes, 20, 5).tolist() == [min(grams[i : i + 16]) for i in range(len(hashes) - 19)]
