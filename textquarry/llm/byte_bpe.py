"""Byte-level BPE by dynamic programming over prefixes.

The BPE encoding of a byte string has a property that makes it computable from left to right: a token sequence is the
encoding of its bytes exactly when every two neighbours encode to themselves. So every prefix has one last token: the
one token that ends there and may stand after the last token of the prefix before it. Storing that token for each prefix
gives exact appends (go on from the stored state) and re-encoding near an edit (go on until the stored state is met).

The text is cut by the tokenizer's pattern first and each match is encoded separately; a match that is a token itself is
that token. No special tokens. Vocabularies are read, never trained.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.words import pieces

#: Encoded matches a worker remembers, at most; then it starts anew.
CACHE = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens by rank from a file of base64 and rank per line; at most some 100,000 entries, so fit for a broadcast."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(x[0]): int(x[1]) for x in lines if x}


class PrefixEncoder:
    """Encodes byte strings with the vocabulary `ranks`."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        #: Pairs (first << 32 | second) of tokens seen so far: whether they encode to themselves.
        self.fits: dict[int, bool] = {}
        #: Tokens that merging can make, as a trie over their bytes from the last one on; a node's token is at -1.
        self.tails: dict = {}
        for t, i in ranks.items():
            if len(t) == 1 or self.merged(t) == [i]:
                node = self.tails
                for byte in reversed(t):
                    node = node.setdefault(byte, {})
                node[-1] = i

    def merged(self, data: bytes) -> list[int]:
        """The encoding by definition: again and again the adjacent pair of lowest rank, leftmost first. Used on pairs of tokens only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, a: int, b: int) -> bool:
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        found = self.fits[a << 32 | b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return found

    def extend(self, data: bytes | bytearray, last: list[int]) -> None:
        """last[i] is the last token of data[:i]; appends it for all longer prefixes."""
        tails, fits = self.tails, self.fits
        for end in range(len(last), len(data) + 1):
            node, at, ending = tails, end, []
            while at and (node := node.get(data[at - 1])) is not None:
                at -= 1
                if -1 in node:
                    ending.append((node[-1], at))
            for t, at in reversed(ending):
                if at:
                    ok = fits.get(last[at] << 32 | t)
                    if not (self.may_follow(last[at], t) if ok is None else ok):
                        continue
                last.append(t)
                break

    def tokens_of(self, last: list[int]) -> list[int]:
        out, at, size = [], len(last) - 1, self.size
        while at:
            t = last[at]
            out.append(t)
            at -= size[t]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        return self.encode_sorted([data])[0]

    def encode_sorted(self, matches: list[bytes]) -> list[list[int]]:
        """The ids of each match; in sorted order, since a match goes on from the prefix that it shares with the one before."""
        out, last, before = [], [-1], b""
        for data in matches:
            if (t := self.ranks.get(data)) is not None:
                out.append([t])
                continue
            same, most = 0, min(len(data), len(before))
            while same < most and data[same] == before[same]:
                same += 1
            del last[same + 1 :]
            self.extend(data, last)
            before = data
            out.append(self.tokens_of(last))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Only the new prefixes are computed."""
        self.data += more
        self.encoder.extend(self.data, self.last)

    def replace(self, begin: int, end: int, by: bytes) -> int:
        """data[begin:end] = by; returns how many prefixes were computed anew.

        After the new bytes, as soon as the longest token's length of consecutive prefixes have their old last tokens,
        all later ones have too.
        """
        old, shift = self.last, len(by) - (end - begin)
        self.data[begin:end] = by
        self.last, same, computed = old[: begin + 1], 0, 0
        for at in range(begin + 1, len(self.data) + 1):
            self.encoder.extend(self.data[:at] if at < len(self.data) else self.data, self.last)
            t = self.last[at]
            computed += 1
            # a token counts as kept only when it lies wholly behind the new bytes
            same = same + 1 if at > begin + len(by) and old[at - shift] == t else 0
            if same >= self.encoder.longest:
                self.last += old[at - shift + 1 :]
                break
        return computed

    def ids(self) -> list[int]:
        return self.encoder.tokens_of(self.last)


_ENCODERS: dict[str, tuple[PrefixEncoder, dict[str, list[int]], dict[int, str]]] = {}


def _encoder(ranks: dict[bytes, int], name: str):
    if name not in _ENCODERS:
        _ENCODERS[name] = PrefixEncoder(ranks), {}, {i: str(i) for i in ranks.values()}
    return _ENCODERS[name]


def _run(ranks_of, name: str, pattern: str, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, cache, number = _encoder(ranks_of.value, name)
        cut = regex.compile(pattern)
        for batch in batches:
            for part in pieces(batch, "txt"):
                column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                lists, counts, id_digests, text_digests = [], [], [], []
                texts = [cut.findall(text or "") for text in column.pop("txt").to_pylist()]
                known = set().union(*texts)
                if len(cache) + len(known) > CACHE:
                    cache.clear()
                missing = sorted((m.encode(), m) for m in known if m not in cache)
                cache.update(zip((m for _, m in missing), encoder.encode_sorted([x for x, _ in missing]), strict=True))
                for matches in texts:
                    ids = list(chain.from_iterable(map(cache.__getitem__, matches)))
                    counts.append(len(ids))
                    id_digests.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                    text_digests.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                    if ids_too:
                        lists.append(ids)
                out = column | {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(id_digests, pa.string()), "decoded_sha256": pa.array(text_digests, pa.string())}
                if ids_too:
                    out["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def tokenized(docs: DataFrame, vocabulary: str, pattern: str, *, doc: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per document: doc, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    Null texts are empty: no tokens and the digests of nothing. Matches of any length are encoded whole; repeated rows
    each get a row; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{text}`").alias("txt"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    name = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return slim.mapInArrow(_run(spark.sparkContext.broadcast(ranks), name, pattern, ids), schema).withColumnRenamed("id", doc)


def _decode(ranks_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: t for t, i in ranks_of.value.items()}
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = column.pop("ids").to_pylist()
            yield pa.RecordBatch.from_pydict(column | {"decoded": pa.array([None if x is None else b"".join(map(token.__getitem__, x)) for x in lists], pa.binary())})

    return run


def decoded(encoded: DataFrame, vocabulary: str, *, doc: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc, decoded (binary) of a table with lists of ids; a null list decodes to null."""
    slim = encoded.select(F.col(f"`{doc}`").alias("id"), F.col(f"`{ids}`").alias("ids"))
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    return slim.mapInArrow(_decode(ranks), f"id {slim.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", doc)
