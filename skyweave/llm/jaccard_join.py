"""N-gram Jaccard join with signature trees, as connected classes of similar documents.

1. Every document becomes its set of distinct 5-word shingles (64-bit hashes); equal sets are one class at once.
2. Over unrelated documents OR-combined bitmaps fill up and prune nothing, so class representatives are first brought
   to neighbourhoods: those that agree in one of BANDS bands of min-hashes (a pair at the threshold is missed with a
   chance of (1 - 0.75**4)**64 = 3e-11, nearer pairs less). Each neighbourhood is a connected part of these agreements.
3. In a neighbourhood a signature tree is built: leaves are documents in order of size, nodes hold the OR of their
   bitmaps and their size ranges. The tree is traversed against itself; a pair of nodes is left when the largest overlap
   that bitmaps and sizes allow is too small for the threshold, or when all below is linked already. What is left at the
   leaves is decided on the sets themselves.
4. A neighbourhood over the block limits is dealt in blocks, each together with one common document; those that do not
   get linked to it then meet all blocks. Links are spanning forests, never all pairs.

Cases: null, empty or blank texts have no shingles and stand alone; texts under five words are one shingle; rows that
repeat a doc_id share its class; null doc_ids stand alone; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from .words import Words, mix, slices, stored, window_hash, window_starts

SHINGLE, BANDS, ROWS = 5, 64, 4
#: The threshold as a fraction, so that it is exact: PART * overlap >= WHOLE * union.
PART, WHOLE = 100, 75
#: Limits of a block: shingles in all, and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 4_000
BITMAP_WORDS, FAN = 32, 8
_rng = np.random.default_rng(17)
MULTIPLY = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and their len + 1 offsets."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    starts = window_starts(words, SHINGLE)
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    values = [window_hash(hashes, starts, SHINGLE)]
    rows = [words.row[starts]]
    for n in range(1, SHINGLE):
        some = short[words.counts[short] == n]
        values.append(mix(window_hash(hashes, words.first[some], n) + np.uint64(n)))
        rows.append(some)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    once = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])][: len(value)]
    value, row = value[once], row[once]
    return value, np.searchsorted(row, np.arange(len(words.counts) + 1))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            value, offsets = shingles(part.column("text"))
            raw = value.tobytes()
            sizes = np.diff(offsets)
            digests = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).digest() if y > x else None for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            some = np.flatnonzero(sizes)
            bands = np.zeros((len(sizes), BANDS), np.uint64)
            if len(some):
                half = (value >> np.uint64(32)).astype(np.uint32)
                for k in range(BANDS):
                    key = np.full(len(some), k, np.uint64)
                    for r in range(k * ROWS, (k + 1) * ROWS):
                        key = mix(key ^ np.minimum.reduceat(half * MULTIPLY[r] + ADD[r], offsets[some]).astype(np.uint64))
                    bands[some, k] = key
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), flat)
            yield pa.record_batch([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], ["doc_id", "n_shingles", "digest", "bands"])


class Links:
    """Which items are linked so far."""

    def __init__(self, n: int, parts: list | None = None):
        self.up = np.arange(n)
        first: dict = {}
        for i, p in enumerate(parts or []):
            if p is not None:
                self.up[i] = first.setdefault(p, i)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        up = self.up
        while (up[up] != up).any():
            up = up[up]
        self.up = up.copy()
        return up


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return PART * both >= WHOLE * (len(x) + len(y) - both)


class SignatureTree:
    """Levels from the leaves up; a level holds the OR bitmaps, size ranges, least bits and most doubled bits of nodes."""

    def __init__(self, sets: list[np.ndarray]):
        maps = np.zeros((len(sets), BITMAP_WORDS), np.uint64)
        for i, s in enumerate(sets):
            bit = s % np.uint64(BITMAP_WORDS * 64)
            np.bitwise_or.at(maps[i], (bit >> np.uint64(6)).astype(int), np.uint64(1) << (bit & np.uint64(63)))
        size = np.array([len(s) for s in sets])
        bits = np.bitwise_count(maps).sum(1).astype(int)
        self.levels = [(maps, size, size, size - bits)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def may_match(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the largest possible overlap of what lies below the nodes reaches the threshold."""
        maps, low, high, slack = self.levels[level]
        common = np.bitwise_count(maps[i] & maps[j]).sum(1).astype(int)
        most = np.minimum(common + np.minimum(slack[i], slack[j]), np.minimum(high[i], high[j]))
        return (PART + WHOLE) * most >= WHOLE * (low[i] + low[j])

    def pairs(self, links: Links) -> Iterator[tuple[int, int]]:
        """Dual traversal: leaf pairs that may match and are not linked when they are reached."""
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, int), np.zeros(1, int))]
        while work:
            level, i, j = work.pop()
            root = links.roots()
            at = np.arange(0, len(root), FAN**level)
            least, most = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
            linked = (least[i] == most[i]) & (least[j] == most[j]) & (least[i] == least[j])
            keep = ~linked & self.may_match(level, i, j)
            if level == 0:
                keep &= i < j
            i, j = i[keep], j[keep]
            if level == 0:
                yield from zip(i.tolist(), j.tolist())
                continue
            n = len(self.levels[level - 1][0])
            for a in range(0, len(i), 4096):
                step = np.arange(FAN)
                x = (i[a : a + 4096, None, None] * FAN + step[:, None]) + np.zeros(FAN, int)
                y = (j[a : a + 4096, None, None] * FAN + step[None, :]) + np.zeros((FAN, 1), int)
                x, y = x.ravel(), y.ravel()
                there = (x <= y) & (y < n) & (x < n)
                work.append((level - 1, x[there], y[there]))


def _link_block(table: pa.Table) -> pa.Table:
    """Links between the documents of each neighbourhood in this task; `part` says what is linked already."""
    table = table.sort_by([("hood", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    text = table.column("text").combine_chunks()
    sets: list[np.ndarray] = []
    for a, b in slices(text):
        value, offsets = shingles(text.slice(a, b - a))
        sets += [value[x:y] for x, y in zip(offsets[:-1], offsets[1:])]
    hoods, docs, parts = (table.column(c).to_pylist() for c in ("hood", "doc_id", "part"))
    out: list[tuple[int, int]] = []
    bounds = [0, *(i for i in range(1, len(hoods)) if hoods[i] != hoods[i - 1]), len(hoods)]
    for a, b in zip(bounds[:-1], bounds[1:]):
        order = sorted((i for i in range(a, b) if len(sets[i])), key=lambda i: (len(sets[i]), docs[i]))
        own = [sets[i] for i in order]
        links = Links(len(own), [parts[i] for i in order])
        pivot = next((k for k, i in enumerate(order) if docs[i] == hoods[i]), 0)

        def verify(x: int, y: int) -> None:
            if links.find(x) != links.find(y) and similar(own[x], own[y]):
                links.join(x, y)
                out.append((docs[order[x]], docs[order[y]]))

        for k in range(len(own)):
            verify(pivot, k)
        if len(own) > 2:
            for x, y in SignatureTree(own).pairs(links):
                verify(x, y)
    return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def similar_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id reachable by links of similar documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(texts.mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, bands array<long>"), "sketches")
    some = sketches.filter("digest is not null and doc_id is not null")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("first"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n"))
    bands = classes.select("first", F.explode("bands").alias("band"))
    least = bands.groupBy("band").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most")
    agree = bands.join(least, "band").filter("first <> least")  # a hot band is only counted before, and split by Spark here
    hoods = components(agree.select(F.col("first").alias("a"), F.col("least").alias("b")).distinct())
    hoods = hoods.select(F.col("node").alias("doc_id"), F.col("component").alias("hood"))
    loads = hoods.join(classes.groupBy(F.col("first").alias("doc_id")).agg(F.max("n").alias("n")), "doc_id")
    totals = loads.groupBy("hood").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"), F.sum("n").alias("load"))
    placed = stored(hoods.join(totals, "hood"), "hoods")
    tasks = max(1, (placed.agg(F.sum(F.col("load") / F.col("blocks"))).first()[0] or 0) // BLOCK_SHINGLES + 1)
    tasks = min(tasks, 1 << 40)
    members = texts.join(placed, "doc_id")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    small = F.pmod(F.xxhash64("hood"), F.lit(int(tasks) * 8)).cast("long")
    large = F.xxhash64("hood", "block").bitwiseOR(F.lit(-(1 << 63)))  # below zero, apart from the small ones
    # the common document of a hood of several blocks goes to all of them
    dealt = members.withColumn("block", F.explode(F.when((F.col("doc_id") == F.col("hood")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block.cast("int")))))
    first = dealt.select(F.when(F.col("blocks") > 1, large).otherwise(small).alias("task"), "hood", "doc_id", "text", F.lit(None).cast("long").alias("part"))
    links = stored(first.groupBy("task").applyInArrow(_link_block, "a long, b long"), "links1")
    if not placed.filter("blocks > 1").isEmpty():
        links = links.union(_across_blocks(texts, placed, links))
    found = components(links).select(F.col("node").alias("first"), "component")
    first_of = some.join(classes.select("digest", "first"), "digest").join(found, "first", "left")
    own = first_of.groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("component"))
    return sketches.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _across_blocks(texts: DataFrame, placed: DataFrame, links: DataFrame) -> DataFrame:
    """In hoods of several blocks, those not yet linked to the common document meet all blocks."""
    part = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    large = placed.filter("blocks > 1").join(part, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    pivot = large.filter("doc_id = hood").select("hood", F.col("part").alias("pivot_part"))
    state = large.join(pivot, "hood").withColumn("rest", F.col("part") != F.col("pivot_part"))
    rests = state.filter("rest").groupBy("hood").agg(F.ceil(F.count("*") / F.lit(BLOCK_DOCS // 2)).cast("int").alias("rest_blocks"))
    state = stored(state.join(rests, "hood"), "rests")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("rest_blocks")).cast("int")
    everyone = state.select("hood", "doc_id", "part", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("rest_block"))
    resting = state.filter("rest").select("hood", "doc_id", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), mine.alias("rest_block"))
    pairs = everyone.union(resting).distinct()
    rows = texts.join(pairs, "doc_id").select(F.xxhash64("hood", "block", "rest_block").alias("task"), "hood", "doc_id", "text", "part")
    return stored(rows.groupBy("task").applyInArrow(_link_block, "a long, b long"), "links2")
