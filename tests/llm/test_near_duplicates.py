from __future__ import annotations

import os
import re
from collections import Counter

import pytest

from tests.llm.conftest import SCHEMA, sentence
from textquarry.llm.graph import components
from textquarry.llm.near_duplicates import bands_and_rows, deduplicated, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """class id and links of each row, all pairs compared."""
    sets = [(shingles(t), t or "") for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            (a, s), (b, t) = sets[i], sets[j]
            if (len(a & b) >= 0.8 * len(a | b) - 1e-9) if a and b else (not a and not b and s == t):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(d)
    return sorted(((d, min((x for x in members[find(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def result(df, **options):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(df, **options).collect()), key=repr)


def test_bands_reach_the_recall():
    b, r = bands_and_rows(0.8, 0.999, 160)
    assert b * r <= 160 and 1 - (1 - 0.8**r) ** b >= 0.999
    with pytest.raises(ValueError):
        bands_and_rows(0.1, 0.999999, 5)


def test_equals_all_pairs(odd):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])


def test_large_group_in_chunks(spark):
    """A group of near copies beyond a block: chunks are compared with each other and no link is lost."""
    base = sentence(5, 120).split()
    rows = []
    for i in range(60):
        own = list(base)
        own[(i * 7) % 118] = f"edit{i}"
        if i % 3 == 0:
            own[(i * 11) % 118] = f"more{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, sentence(50 + i, 40)) for i in range(10)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    assert result(df, block_rows=16) == brute(rows) == result(df)


def test_empty(none):
    assert near_duplicates(none).count() == 0


def test_one_of_each_group_stays(odd):
    got = deduplicated(odd)
    assert got.columns == odd.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([1, 3, None, 6, 7, 8, 9, 10, 12, 12], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def test_an_empty_chunk_counts_no_link_again(spark):
    rows = [(3 * c + k, sentence(c + 50, 300) + f" end{k}") for c in range(12) for k in range(3)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    got = near_duplicates(df, block_grams=600).collect()
    assert {(r.n_text_links, r.n_links, r.class_id % 3) for r in got} == {(2, 2, 0)}


def test_rows_without_an_id(spark):
    """A thousand of them: each text is found by its digest, copies meet once, one of each group stays."""
    rows = [(None, sentence(i // 4, 30) + (" new end" if i % 4 == 3 else "")) for i in range(1000)] + [(5, sentence(0, 30))]
    df = spark.createDataFrame([(d, t, "en", "s", i) for i, (d, t) in enumerate(rows)], SCHEMA).repartition(7)
    assert result(df) == brute(rows)
    kept = deduplicated(df).collect()
    assert len(kept) == 250 and sum(r.doc_id == 5 for r in kept) == 1


def test_ties_are_decided_by_the_other_columns(spark):
    rows = [(1, sentence(1, 30), lang, f"s{n}", n) for n, lang in enumerate(["de", "en", None, "fr", "de"])] + [(1, sentence(1, 30) + ".", "xx", "s", 0), (2, None, "b", "s", 0), (2, "", "a", "s", 0)]
    for seed in range(3):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3 + seed)
        got = {r.doc_id: (r.text, r.lang, r.n_chars) for r in deduplicated(df).collect()}
        assert set(got) == {1, 2} and got[2] == ("", "a", 0)
        assert got == {r.doc_id: (r.text, r.lang, r.n_chars) for r in deduplicated(df.orderBy("n_chars")).collect()}


def test_hubs_are_split(spark):
    """A star of 5,000 edges and many pairs."""
    edges = [(i, 0) for i in range(1, 5001)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(2000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(got) == 7000 and all(got[i] == 0 for i in range(1, 5001)) and got[10_001] == 10_000


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_against_all_pairs(spark):
    """Linked pairs of the whole table, counted at both ends, against every pair's true similarity."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: (c, n) for d, c, n in brute(rows)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    linked = sum(n for _, n in want.values())
    assert linked > 100
    assert all(n <= want[d][1] for d, (_, n) in got.items())  # no false link
    assert sum(n for _, n in got.values()) >= 0.99 * linked
