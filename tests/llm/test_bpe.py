from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.llm.byte_bpe import PrefixEncoder, Prefixes, decoded, read_ranks, tokenized

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
ENCODER = PrefixEncoder(RANKS)
TIKTOKEN = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeiothns éßñ漢字🙂и 0129!?.\n\t"), max_size=60))
def test_equals_tiktoken(text):
    import regex

    assert [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in ENCODER.encode(m.encode())] == TIKTOKEN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=6), st.integers(0, 40), st.integers(0, 5), st.binary(max_size=10))
def test_appends_and_edits_are_exact(data, by, begin, n, more):
    p = Prefixes(ENCODER, data)
    assert p.ids() == ENCODER.merged(data) if data else p.ids() == []
    begin = min(begin, len(data))
    end = min(begin + n, len(data))
    p.replace(begin, end, by)
    p.append(more)
    now = data[:begin] + by + data[end:] + more
    assert bytes(p.data) == now and p.last == Prefixes(ENCODER, now).last


def test_an_edit_is_local():
    p = Prefixes(ENCODER, b"the quick brown fox " * 500)
    assert p.replace(4000, 4003, b"xyz") < 300


def test_table(spark, odd, none):
    rows = tokenized(odd, PATH, public_tokenizers.PATTERN, ids=True)
    texts = sorted(r.text or "" for r in odd.select("text").collect())
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows.collect())
    want = [(len(i := TIKTOKEN.encode_ordinary(t)), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for t in texts]
    assert got == sorted(want)
    assert sorted(bytes(r.decoded) for r in decoded(rows, PATH).collect()) == sorted(t.encode() for t in texts)
    assert tokenized(none, PATH, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("ids", [[], [300, 5]])
def test_decode(ids):
    assert ENCODER.decode(ids) == TIKTOKEN.decode_bytes(ids)
