"""Words of UTF-8 text as numpy arrays.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: ASCII letters and digits and every
character outside ASCII. All such characters' UTF-8 bytes are word bytes too, so bytes can be classified
without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
IS_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)[LOWER] | np.uint64(1)
_PLACES = 1 << 14
_PLACE_VALUE = _RANDOM.integers(1, 2**63, _PLACES, dtype=np.uint64) | np.uint64(1)
_GRAM_VALUE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: hashes, byte spans in `data`, and `at`, where each text's words begin (n + 1 entries)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.lowered: bytes | None = None
        size = len(data)
        is_word = IS_WORD[data]
        before = np.empty(size + 1, bool)
        before[0] = False
        before[1:] = is_word
        after = np.empty(size + 1, bool)
        after[:-1] = is_word
        after[-1] = False
        after = after[1:]
        before = before[:-1]
        inner = offsets[(offsets > 0) & (offsets < size)]
        before[inner] = False
        after[inner - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.at = np.searchsorted(self.start, offsets)
        if len(self.start):
            length = self.end - self.start
            taken = np.flatnonzero(is_word)
            first = np.cumsum(length) - length
            place = np.arange(len(taken)) - np.repeat(first, length)
            value = _BYTE_VALUE[data[taken]] * _PLACE_VALUE[place % _PLACES]
            value ^= value >> np.uint64(29)
            self.hash = mixed(np.add.reduceat(value, first) + length.astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; the last k - 1 words of a text have none that count."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total = self.hash[:n] * _GRAM_VALUE[0]
        for j in range(1, k):
            total += self.hash[j : j + n] * _GRAM_VALUE[j % 64]
        return mixed(total + np.uint64(k))

    def slice_key(self, i: int, k: int) -> bytes:
        """The k words from word i on, lower-cased and joined by blanks."""
        if self.lowered is None:
            self.lowered = LOWER[self.data].tobytes()
        raw = self.lowered
        return b" ".join([raw[a:b] for a, b in zip(self.start[i : i + k].tolist(), self.end[i : i + k].tolist(), strict=True)])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, nulls as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, so temporaries stay small; a longer text stands alone."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_buffers(column)
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
