from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict

from textquarry.llm import sharding
from textquarry.llm.quality_rules import quality_rules
from textquarry.llm.sharding import dealt, shard_groups


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_base_counts(spark, odd):
    more = spark.createDataFrame([(50, "a b c d e " * 9), (51, "q\nq\n \nq"), (52, "a b c d e f a b c d e"), (53, "a\x0bb\x0cc\rd\x1ce |<>"), (54, "a a a a a a")], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    want = sorted(((r.doc_id, *base(r.text)) for r in df.collect()), key=repr)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules(df).collect()), key=repr)
    assert got == want


def test_kept_needs_the_base_and_all_rules(odd):
    for r in quality_rules(odd).collect():
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_have_no_user_function(odd):
    plan = quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_runs_of_equal_groups_are_dealt_as_by_a_heap():
    for count in (0, 1, 63, 64, 65, 200, 999):
        for loads in ([0] * 4, [5, 0, 9, 2], [100, 1, 1, 0], [3, 3, 3, 3]):
            heap = [(x, j) for j, x in enumerate(loads)]
            heapq.heapify(heap)
            want = [0] * 4
            for _ in range(count):
                x, j = heap[0]
                want[j] += 1
                heapq.heapreplace(heap, (x + 7, j))
            assert dealt(list(loads), 7, count) == want


def test_shards(odd, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    rows = shard_groups(odd, shards=4).collect()
    texts = sorted((r.text or "" for r in odd.select("text").collect()))
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts)
    groups, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        groups[r.size, r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert (r.law, r.grown_shard) == ("bytes", None)
    assert all(len(x) == 1 for x in groups.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    weights = Counter()
    for t in texts:
        weights[t] += len(t.encode()) + 1
    heap = [(0, j) for j in range(4)]
    for w in sorted(weights.values(), reverse=True):
        x, j = heap[0]
        heapq.heapreplace(heap, (x + w, j))
    assert sorted(x for x, _ in heap if x) == sorted(loads.values())


def test_no_rows(none):
    assert shard_groups(none).count() == 0 and quality_rules(none).count() == 0
