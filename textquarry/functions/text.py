"""Text kernel: normalisation, hashes, chemical fields, n-grams, lexical similarity, highlighting.

All but NFKC and highlighting are built-in expressions. NFKC runs on Arrow columns in pyarrow's own kernel.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The content alphabet (with the dotless i that case-insensitive matching keeps) and the chemical fields.
NOT_CONTENT = "[^0-9a-zı㐀-鿿]+"
CHEMICAL_FIELD = (
    r"(?iu)(?:CAS(?:\s*(?:No\.?|号))?|分子式|Molecular\s*Formula|分子量|Molecular\s*Weight|Mol\.?\s*Wt\.?|规格(?:参数)?|Specification|纯度|Purity)"
    r"\s*[:：]?\s*[^\n；;。]{1,100}"
)
CAS_NUMBER = r"(?<!\d)\d{2,7}-\d{2}-\d(?!\d)"
PERCENTAGE = r"(?<!\w)(?:≥|>|≤|<)?\s*\d{1,3}(?:\.\d+)?\s*%(?!\w)"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Unicode NFKC, a column at a time; texts that have the form already, nearly all, only cost the quick check."""
    return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def clean_display_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(nfkc(text), WHITESPACE, " "))


def normalized(text: Column) -> Column:
    """NFKC, lower case, only the content alphabet. Every other character goes, accented letters among them."""
    return F.regexp_replace(F.lower(nfkc(text)), NOT_CONTENT, "")


def hash_of(normal: Column) -> Column:
    return F.sha2(normal, 256)


def without_chemicals(text: Column) -> Column:
    """Raw text with labelled fields, CAS numbers and percentages blanked. Labels also match inside words."""
    out = F.regexp_replace(text, CHEMICAL_FIELD, " ")
    out = F.regexp_replace(out, CAS_NUMBER, " ")
    return F.regexp_replace(out, PERCENTAGE, " ")


def chemical_core(text: Column) -> Column:
    return normalized(without_chemicals(text))


def chemical_ratio(normal: Column, core: Column) -> Column:
    """Share of the normalised text that chemical fields make up."""
    return F.when(F.length(normal) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.length(core) / F.length(normal)))).otherwise(F.lit(0.0))


def embedded_text(normal: Column, core: Column) -> Column:
    return F.when(F.length(core) >= 3, core).otherwise(normal)


def ngrams(normal: Column, size: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own n-gram, an empty one has none.

    Look-ahead yields all overlapping matches in one pass; the alphabet has no surrogate pairs.
    """
    short = F.when(F.length(normal) > 0, F.array(normal)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(normal) >= size, F.array_distinct(F.regexp_extract_all(normal, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)))).otherwise(short)


def coded(grams: Column) -> Column:
    """The n-grams as 64-bit hashes: sets of numbers intersect several times faster than sets of strings.

    n distinct n-grams collide with a chance of n^2 / 2^65; there are about 10^5 different ones in a language.
    """
    return F.transform(grams, lambda g: F.xxhash64(g))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column, both: Column | None = None) -> Column:
    """|a & b| / |a | b| of arrays of distinct values; 0 where either is empty.

    `both` is their overlap() where it is a column already: used twice here, an expression would be computed twice.
    """
    both = overlap(a, b) if both is None else both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard_bound(a: Column, b: Column) -> Column:
    """No Jaccard similarity of sets of these sizes is larger."""
    return F.when((a == 0) | (b == 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.90, "high").when(score >= 0.75, "medium").otherwise("low")


class _Automaton:
    """The suffix automaton of a string: a state for each set of substrings that end at the same places, with the first of them."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]
        last = 0
        for at, c in enumerate(text, 1):
            state = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            self.first.append(at)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    # the shorter strings of q end at more places: they get a state of their own
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.link.append(self.link[q])
                    self.length.append(self.length[p] + 1)
                    self.first.append(self.first[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = copy
                    q = copy
                self.link[state] = q
            last = state

    def longest(self, text: str) -> tuple[int, int, int]:
        """(place in text, place in the automaton's string, length) of the longest common substring: of equal ones the first
        in text, then in the string."""
        state = size = 0
        best = (0, 0, 0)
        for at, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size > best[2]:
                best = (at - size, self.first[state] - size, size)
        return best


def common_blocks(a: str, b: str, least: int) -> list[tuple[int, int, int]]:
    """The longest common block, then those left and right of it on both sides, as long as they have `least` characters: (place
    in a, place in b, length). A range is searched in time of its length, as its automaton takes no more."""
    out, ranges = [], [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        if a1 - a0 < least or b1 - b0 < least:
            continue
        i, j, size = _Automaton(b[b0:b1]).longest(a[a0:a1])
        if size >= least:
            out.append((a0 + i, b0 + j, size))
            ranges += [(a0, a0 + i, b0, b0 + j), (a0 + i + size, a1, b0 + j + size, b1)]
    return out


def segments(query: str, original: str, least: int = 3) -> list[dict]:
    """Runs of matched and unmatched characters of `original`."""
    if not original:
        return []
    hit = bytearray(len(original))
    for _, at, size in common_blocks(query.lower(), original.lower(), least):
        end = min(at + size, len(original))
        hit[at:end] = b"\x01" * max(0, end - at)
    edges = [0, *(i for i in range(1, len(original)) if hit[i] != hit[i - 1]), len(original)]
    return [{"text": original[a:b], "matched": bool(hit[a])} for a, b in zip(edges, edges[1:], strict=False)]


SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("matched", T.BooleanType())]))


@F.pandas_udf(SEGMENTS)
def highlight(query: pd.Series, original: pd.Series) -> pd.Series:
    """For the few rows that survive scoring only."""
    return pd.Series([segments(q or "", o or "") for q, o in zip(query, original, strict=True)])
