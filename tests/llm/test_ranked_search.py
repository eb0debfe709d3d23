from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textquarry.llm import ranked_search
from textquarry.llm.ranked_search import Index, Items, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, score int, rank int, id int, txt string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items):
    """(item_id, rank, doc_id, score) by scoring every document."""
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:10])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [(i, " ".join(words[min(vocabulary - 1, int(rnd.expovariate(0.02)))] for _ in range(rnd.randrange(1, 60)))) for i in range(n)]


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, item_id string, score long").repartition(3)
    return d, spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in items], ITEMS)


@pytest.mark.parametrize("shares", [(0.1, 0.4), (0.05, 0.2, 0.5, 0.9), ()])
def test_as_brute_force_with_any_tiers(spark, shares):
    docs = corpus(1, 300)
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties beyond ten
    items = [(1, docs[7][1]), (2, docs[20][1].upper()), (3, "w399 w399 w398 w0 unknownword"), (4, "w0"), (5, " ".join(t for _, t in docs[:5]))]
    assert rows_of(search(*frames(spark, docs, items), shares=shares)) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, "Stone river stone"), (1, "Stone river stone"), (2, None), (3, ""), (4, "... !!"), (None, "stone river stone"), (None, None), (5, "éclair ÉCLAIR 漢字 stone"), (6, "river " * 20_000), (7, "x" * 200_000 + " stone"), (8, "every"), (9, "every")]
    items = [(1, "stone"), (1, "stone"), (2, None), (3, ""), (None, "river STONE river"), (5, "ÉCLAIR 漢字"), (6, "nothing here"), (7, "x" * 200_000)]
    got = rows_of(search(*frames(spark, docs, items)))
    assert got == brute(docs, list(dict.fromkeys(items)))
    assert [d for i, _, d, _ in got if i == 5] == [5]  # only A-Z is lower-cased


def test_empty_tables_and_blocks_of_items(spark):
    docs, items = corpus(2, 60), [(i, f"w{i} w{2 * i} w{i + 7}") for i in range(1, 30)]
    d, q = frames(spark, docs, items)
    for got in (search(d.limit(0), q), search(d, q.limit(0)), search(d.limit(0), q.limit(0))):
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows_of(search(d, q, block_bytes=400)) == brute(docs, items)


def test_first_tiers_prove_items_and_others_fall_through(spark):
    rnd = random.Random(3)
    rare = [f"rare{i}" for i in range(12)]
    docs = [(i, t) for i, t in corpus(4, 500, 40)] + [(600 + i, " ".join(rare) + f" w{i}") for i in range(12)]
    d, _ = frames(spark, docs, [(1, "x")])
    index = Index(d.selectExpr("doc_id as id", "text as txt"), Items.of([" ".join(rare), "w0 w1 w2", " ".join(rnd.choices([f"w{i}" for i in range(40)], k=30))]), (0.02, 0.3))
    found, proven = index.search()
    assert proven[0] >= 1 and sum(proven) == 3 and proven[-1] >= 1, proven
    assert found.filter("item = 0").count() == 10
    # residuals bound what lies below a tier
    for tiers in range(1, index.tiers):
        residual = index.residual(tiers)
        for row in index.blocks.collect():
            for k in range(tiers, index.tiers):
                term, impact = np.frombuffer(row[f"term{k}"], np.int32), np.frombuffer(row[f"impact{k}"], np.int64)
                assert (impact <= residual[term]).all()


def test_sums_beyond_doubles():
    key, value = np.array([0, 0, 1]), np.array([2**54 + 1, 2**54 + 2, 5])
    assert ranked_search._sums(key, value, 3, 2).tolist() == [2**55 + 3, 5, 0]
