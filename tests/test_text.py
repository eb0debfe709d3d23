"""Text kernel against direct Python."""

from __future__ import annotations

import hashlib
import re
import time
import unicodedata
from difflib import SequenceMatcher
from random import Random

from pyspark.sql import functions as F

from textquarry.functions import text as t
from textquarry.operators import embedding, similarity

CASES = [
    "", "a", "ab", "abc", "  Plain  text ", "ＦＵＬＬ　ｗｉｄｔｈ １２", "ı İ ſ K", "Éa ü", "漢字 かな 한글", "㏿㐀鿿ꀀ", "x\x1cy\x1fz",
    "CAS: 1000573-03-4; Purity: 99%", "case closed; more words here", "about 50.5% and ≥ 99 %", "12345678-12-3 and 123-45-6", "规格：10g。 rest", "!!!", None,
]


def normal(x: str) -> str:
    return re.sub("[^0-9a-z㐀-鿿]+", "", unicodedata.normalize("NFKC", x).lower(), flags=re.I)


def test_normalisation_and_hash(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i int, x string")
    got = {r.i: r for r in rows.select("i", t.normalized(F.col("x")).alias("n"), t.hash_of(t.normalized(F.col("x"))).alias("h"), t.clean_display_text(F.col("x")).alias("d")).collect()}
    for i, x in enumerate(CASES):
        if x is None:
            assert got[i].n is None
            continue
        assert got[i].n == normal(x), x
        assert got[i].h == hashlib.sha256(normal(x).encode()).hexdigest()
        assert got[i].d == re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip()


def test_chemical_core(spark):
    rows = similarity.prepare(spark.createDataFrame([(x,) for x in ("CAS: 1000573-03-4; Purity: 99%", "keep 50% this", "casual words\nnext", "1234-56-7")], "original_content string"))
    got = {r.original_content: r for r in rows.collect()}
    assert got["CAS: 1000573-03-4; Purity: 99%"].core == ""
    assert got["CAS: 1000573-03-4; Purity: 99%"].chemical_ratio == 1.0
    assert got["keep 50% this"].core == "keepthis"
    assert got["casual words\nnext"].core == "next"  # labels match inside words
    assert got["1234-56-7"].core == "" and got["1234-56-7"].embed_text == "1234567"


def test_ngrams_and_jaccard(spark):
    rows = spark.createDataFrame([("abcabc", "abcd"), ("ab", "ab"), ("", "abc"), ("abc", "xyz")], "a string, b string")
    got = rows.select(t.jaccard(t.ngrams(F.col("a")), t.ngrams(F.col("b"))).alias("j"), t.jaccard(t.coded(t.ngrams(F.col("a"))), t.coded(t.ngrams(F.col("b")))).alias("k")).collect()
    assert [r.j for r in got] == [0.25, 1.0, 0.0, 0.0] == [r.k for r in got]


def test_highlight():
    assert t.segments("abcdef", "xxabcdyy") == [{"text": "xx", "matched": False}, {"text": "abcd", "matched": True}, {"text": "yy", "matched": False}]
    assert t.segments("ab", "") == []
    assert t.segments("zz", "ab") == [{"text": "ab", "matched": False}]


def test_hash_embedding(spark):
    texts = ["", "a", "abab", "漢字漢"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got: dict = {}
    for r in embedding.sparse(rows, "i", "x").collect():
        got.setdefault(r.i, {})[r.bucket] = r.weight
    for i, x in enumerate(texts):
        want: dict = {}
        for k in range(max(1, len(x) - 1)):
            d = hashlib.sha256(x[k : k + 2].encode()).digest()
            b = int.from_bytes(d[:4], "big") % 512
            want[b] = want.get(b, 0) + (1 if d[4] % 2 == 0 else -1)
        assert got.get(i, {}) == {b: w for b, w in want.items() if w}
        dense = embedding._vectors([x], 512)[0]
        assert {b: int(w) for b, w in enumerate(dense) if w} == got.get(i, {})


def test_common_blocks_as_difflib():
    random = Random(4)
    for n in range(400):
        letters = "ab" if n % 2 else "abcdefgh "
        a = "".join(random.choice(letters) for _ in range(random.randrange(60)))
        b = "".join(random.choice(letters) for _ in range(random.randrange(60)))
        if n % 3 == 0:
            b = a[: len(a) // 2] + b + a[len(a) // 3 :]
        expected = [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 3]
        assert sorted(t.common_blocks(a, b, 3)) == expected, (a, b)


def test_common_blocks_of_long_texts_take_under_a_second():
    random = Random(6)
    words = ["".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(random.randrange(2, 9))) for _ in range(900)]
    text = " ".join(random.choice(words) for _ in range(4000))[:20_000]
    other = "".join(c if random.random() > 0.002 else "#" for c in text)
    began = time.perf_counter()
    hit = sum(len(s["text"]) for s in t.segments(text, other) if s["matched"])
    assert time.perf_counter() - began < 1 and hit > 19_000
