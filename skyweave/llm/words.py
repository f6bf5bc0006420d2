"""Vectorised words and rolling hashes over Arrow text columns.

A word is a maximal run of bytes other than space and 09-0D, as in `[^\\x20\\x09-\\x0D]+` over code points:
these separators are ASCII, so bytes and code points split alike. Null texts count as empty.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared_folder, stored

__all__ = ["BYTE_VALUES", "SPACES", "Words", "chunked", "distinct", "grouped", "mix", "shared_folder", "slices", "sorted_by", "span_hash", "stored", "text_bytes", "window_hash", "window_starts"]

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Texts are hashed in slices of about so many bytes, which bounds the arrays of a task.
SLICE_BYTES = 2_000_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.frombuffer(b"".join(hashlib.sha256(b"byte%d" % i).digest()[:8] for i in range(256)), "<u8") | U64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        _powers[base] = tuple(both)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash look random."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many spans at once."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], dtype=U64, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of whole texts of about `most` bytes; a longer text stands alone."""
    _, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(stop, n)
        row = stop


class Words:
    """The words of some texts: byte spans, row of each word, first word of each row (with one past the end)."""

    def __init__(self, column: pa.Array, lower: bool = False, separators: np.ndarray = SPACES):
        self.data, self.offsets = text_bytes(column)
        data = self.data
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
            self.data = data
        word = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(BYTE_VALUES[self.data], self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def texts(self, picks: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[picks].tolist(), self.end[picks].tolist())]


def window_starts(words: Words, k: int) -> np.ndarray:
    """Indexes of the words at which a window of k words of one text starts."""
    i = np.arange(len(words.start))
    return i[i + k <= words.first[words.row + 1]] if len(i) else i


def window_hash(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return span_hash(hashes, starts, starts + k, 0xD6E8FEB86659FD93)


def sorted_by(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys, as far as the bits beside those of a place tell them apart: one sort of whole numbers."""
    bits = np.uint64(max(1, len(keys).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    return (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)


def grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes, where each is first, and which of them each one is."""
    order = sorted_by(hashes)
    if (hashes[order[1:]] < hashes[order[:-1]]).any():  # two that differ in the bits of a place alone
        order = np.argsort(hashes, kind="stable")
    found = hashes[order]
    new = np.r_[True, found[1:] != found[:-1]][: len(found)]
    which = np.empty(len(found), np.int64)
    which[order] = np.cumsum(new) - 1
    return found[new], order[new], which


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and which of them each one is."""
    found, _, which = grouped(hashes)
    return found, which


def chunked(docs: DataFrame, size: int, most_bytes: int = 4_000_000) -> DataFrame:
    """Deals documents by a hash of doc_id and text to chunks of about `size` rows and `most_bytes`: (chunk, doc_id, text).

    The chunk of a document does not depend on how the input is split; rows that share a doc_id, or have none, are dealt
    by their texts.
    """
    n, total = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    chunks = max(1, -(-n // size), -(-(total or 0) // most_bytes))
    chunk = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
