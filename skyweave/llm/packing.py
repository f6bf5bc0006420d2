"""Packing of documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids (then one end id) are cut into full windows, which stand alone, and a rest, which is cut again into
pieces of at most a quarter of a window. Texts are taken as they stand in a partition: as soon as the rests of some fill
GROUP_WINDOWS windows, their pieces are packed together, so a group is bounded in ids whatever repeats, and nothing is
shuffled. Every piece starts as a partial partition of its own; the two partitions with the largest imbalance are merged,
the fullest windows of one with the emptiest of the other, until one partition with nearly equal windows is left. If a
window then exceeds the capacity, the group is packed again with one window more.

Cases: null text is empty and packs as its end id alone; repeated rows are packed each by itself; a null doc_id is
carried as null; an empty table gives no pieces; other columns are ignored.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_ids import encode
from .words import slices

CAPACITY, END = 2048, 1
#: Windows that rests are packed into together, which bounds the differencing: pieces times windows.
GROUP_WINDOWS = 96


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items by window, the window sums being nearly equal."""
    heap = []
    for i, size in enumerate(sizes):
        sums, items = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], items[0] = size, i
        heap.append((-size, i, sums, items))
    heapq.heapify(heap)
    joined: list[tuple[np.ndarray, np.ndarray]] = []  # what stands together in a window from each merge on
    n = len(sizes)
    while len(heap) > 1:
        _, i, sums, items = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        sums, others = sums + more[::-1], others[::-1]
        both = np.flatnonzero((items >= 0) & (others >= 0))
        joined.append((items[both], others[both]))
        items = np.maximum(items, others)
        items[both] = np.arange(n, n + len(both))
        n += len(both)
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), i, sums, items[order]))
    out: list[list[int]] = [[] for _ in range(windows)]
    if not heap:
        return out
    window = np.full(n, -1)
    final = heap[0][3]
    window[final[final >= 0]] = np.flatnonzero(final >= 0)
    for a, b in reversed(joined):
        n -= len(a)
        window[a] = window[b] = window[n : n + len(a)]
    for i, w in enumerate(window[: len(sizes)].tolist()):
        out[w].append(i)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        packed = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in packed):
            return [w for w in packed if w]
        windows += 1


def _packed(docs: list[tuple[int | None, np.ndarray]], capacity: int, sequence: int) -> tuple[pa.RecordBatch, int]:
    """The pieces of some documents, and the number of the next sequence."""
    rows = []  # document, start, length, sequence, offset
    for d, (_, x) in enumerate(docs):
        for start in range(0, len(x) - capacity + 1, capacity):
            rows.append((d, start, capacity, sequence, 0))
            sequence += 1
    piece = max(1, capacity // 4)
    rests = [(d, s, min(piece, len(x) - s)) for d, (_, x) in enumerate(docs) for s in range(len(x) - len(x) % capacity, len(x), piece)]
    for window in windows_of([n for _, _, n in rests], capacity) if rests else []:
        offset = 0
        for d, s, n in (rests[i] for i in window):
            rows.append((d, s, n, sequence, offset))
            offset += n
        sequence += 1
    own, starts, lengths, *places = zip(*rows)
    longs = [pa.array(c, pa.int64()) for c in (starts, lengths, [len(docs[d][1]) for d in own], *places)]
    pieces = [docs[d][1][s : s + n].tobytes() for d, s, n, _, _ in rows]
    return pa.record_batch([pa.array([docs[d][0] for d in own], pa.int64()), *longs, pa.array(pieces, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids: little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, group, rest = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids, offsets = encode(batch.column("text").slice(a, b - a), tokenizer)
                ids = np.insert(ids.astype("<u4"), offsets[1:], np.uint32(END))
                bounds = (offsets + np.arange(len(offsets))).tolist()
                for i, x, y in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), bounds[:-1], bounds[1:]):
                    group.append((i, ids[x:y]))
                    rest += (y - x) % capacity
                    if rest >= group_windows * capacity or len(group) >= group_windows * 64:
                        out, sequence = _packed(group, capacity, sequence)
                        group, rest = [], 0
                        yield out
        if group:
            yield _packed(group, capacity, sequence)[0]

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
