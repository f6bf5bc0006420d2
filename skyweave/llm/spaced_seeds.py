"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive words: words under a 0 are ignored, so a hit survives substitutions there.
Every place of the benchmark is hashed under every mask; these hashes are joined to those of all training places, and
around each hit the two texts are compared word by word along its diagonal. An overlap is the best-scoring stretch (a
match +1, a substitution -PENALTY) that has LEAST_MATCHES equal words, or all of a shorter item.

Training places are looked up in a bit table of the benchmark's hashes first (of fixed size, broadcast; a larger
benchmark fills it and lets more through). What passes is joined to the benchmark's hashes as rows, so that neither the
benchmark nor the hits meet in the driver or in each task. Texts are known by two hashes of theirs: copies are compared
once, and the result is joined back by these.

Cases: null or empty texts have no hits, on either side; items of fewer words than the span are hashed whole, without a
mask, those of fewer than SHORTEST words are too short to tell and have none; repeated rows get a row each; null doc_ids
and item_ids are carried; an empty benchmark leaves all clean; a column `overlaps` of docs is replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, slices, stored, window_hash

#: Fixed masks, 1 for words that count: contiguous is not among them, so that no single substitution breaks all.
MASKS = ("11101110111", "11011011101", "10111101011")
SPAN = 11
SHORTEST = 3
PENALTY, LEAST_MATCHES = 2, 12
#: Bits of the table of the benchmark's hashes (4 MB), two for each hash; it is put together in so many blocks.
TABLE_BITS, TABLE_BLOCKS = 25, 16
OVERLAPS = "array<struct<item_id:bigint,n_equal:int,first_word:int,end_word:int>>"


def masked_hash(hashes: np.ndarray, starts: np.ndarray, mask: str, number: int) -> np.ndarray:
    total = np.full(len(starts), number + 1, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total = mix(total * np.uint64(31) ^ hashes[starts + j])
    return total


def seeds_of(words: Words, hashes: np.ndarray, whole: bool, lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, hashes) under each mask, and of stretches of the given lengths (whole: whole texts of those)."""
    index = np.arange(len(hashes))
    room = words.first[words.row + 1] - index if len(index) else index
    full = index[room >= SPAN]
    for k, mask in enumerate(MASKS):
        yield SPAN, full, masked_hash(hashes, full, mask, k)
    for n in lengths:
        at = words.first[:-1][words.counts == n] if whole else index[room >= n]
        yield n, at, mix(window_hash(hashes, at, n) + np.uint64(n))


def bits_of(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (seeds >> np.uint64(64 - TABLE_BITS)).astype(np.int64), (seeds & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def best_stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(matches, first, end) of the best stretch of a diagonal, given where it is equal; of equal ones the first."""
    if not equal.any():
        return 0, 0, 0
    sums = np.r_[0, np.cumsum(np.where(equal, 1, -PENALTY))]
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums[1:] - low[:-1])) + 1
    first = int(np.flatnonzero(sums[:end] == low[end - 1])[-1])
    return int(equal[first:end].sum()), first, end


def overlap(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(matches, first word, end word) in the text, if it is enough; item and text are hashes of words."""
    a, b = max(0, -shift), min(len(item), len(text) - shift)
    matches, first, end = best_stretch(item[a:b] == text[a + shift : b + shift])
    return (matches, first + a + shift, end + a + shift) if matches >= min(LEAST_MATCHES, len(item)) else None


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            words = Words(batch.column("text").slice(a, b - a), lower=True)
            items = batch.column("item").to_numpy()[a:b]
            for n, at, seed in seeds_of(words, words.hashes(), True, list(range(SHORTEST, SPAN))):
                row = words.row[at]
                yield pa.record_batch([pa.array(seed.view(np.int64)), pa.array(items[row]), pa.array((at - words.first[row]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32))], ["seed", "item", "place", "length"])


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(1 << TABLE_BITS, bool)
    for batch in batches:
        for bit in bits_of(batch.column("seed").to_numpy().view(np.uint64)):
            table[bit] = True
    yield pa.record_batch([pa.array(range(TABLE_BLOCKS), pa.int32()), pa.array([np.packbits(x).tobytes() for x in np.split(table, TABLE_BLOCKS)], pa.binary())], ["block", "bits"])


def _united(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("bits")])
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})


def _suspects(shared, lengths: list[int]):
    """Texts with a place whose hash the table may hold: with these hashes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = Words(part.column("text"), lower=True)
                rows, seeds, places = [], [], []
                for _, at, seed in seeds_of(words, words.hashes(), False, lengths):
                    one, two = bits_of(seed)
                    maybe = np.flatnonzero((table[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & 1)
                    maybe = maybe[((table[two[maybe] >> 3] >> (7 - (two[maybe] & 7)).astype(np.uint8)) & 1) == 1]
                    rows.append(words.row[at[maybe]])
                    seeds.append(seed[maybe])
                    places.append(at[maybe] - words.first[rows[-1]])
                row, seed, place = np.concatenate(rows), np.concatenate(seeds), np.concatenate(places)
                order = np.argsort(row, kind="stable")
                some, begin = np.unique(row[order], return_index=True)
                offsets = pa.array(np.r_[begin, len(order)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (seed[order].view(np.int64), place[order].astype(np.int32))]
                kept = part.take(pa.array(some))
                yield pa.record_batch([kept.column("_hash"), kept.column("_check"), kept.column("text"), *lists], ["_hash", "_check", "text", "seeds", "places"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_equal", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32())]))
    for batch in batches:
        out = []
        for text, near in zip(batch.column("text"), batch.column("near")):
            own, found = Words(pa.array([text.as_py()]), lower=True).hashes(), []
            for x in near.as_py():
                item = Words(pa.array([x["item_text"]]), lower=True).hashes()
                best = max((o for s in x["shifts"] if (o := overlap(item, own, s))), default=None)
                if best:
                    found.append({"item_id": x["item_id"], "n_equal": best[0], "first_word": best[1], "end_word": best[2]})
            out.append(sorted(found, key=lambda f: (f["item_id"] is not None, f["item_id"] or 0, -f["n_equal"])))
        yield pa.record_batch([batch.column("_hash"), batch.column("_check"), pa.array(out, kind)], ["_hash", "_check", "overlaps"])


def text_keys(text: F.Column) -> dict:
    """Two hashes that stand for a text."""
    return {"_hash": F.xxhash64(F.coalesce(text, F.lit(""))), "_check": F.hash(F.lit("text"), F.coalesce(text, F.lit("")))}


def text_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_hash, _check, overlaps) of the texts that have overlaps, each text once; overlaps by item."""
    spark = docs.sparkSession
    items = stored(benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text"), F.monotonically_increasing_id().alias("item")), "items")
    seeds = stored(items.select("item", F.col("item_text").alias("text")).mapInArrow(_item_seeds, "seed long, item long, place int, length int"), "seeds")
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect() if r.length < SPAN)
    blocks = seeds.select("seed").mapInArrow(_filled, "block int, bits binary").groupBy("block").applyInArrow(_united, "block int, bits binary").collect()
    table = np.concatenate([np.frombuffer(r.bits, np.uint8) for r in sorted(blocks, key=lambda r: r.block)]) if blocks else np.zeros(1 << TABLE_BITS >> 3, np.uint8)
    shared = spark.sparkContext.broadcast(table)
    probed = docs.select("text").filter("text is not null").withColumns(text_keys(F.col("text")))
    suspects = stored(probed.mapInArrow(_suspects(shared, lengths), "_hash long, _check int, text string, seeds array<long>, places array<int>"), "suspects")
    placed = suspects.select("_hash", "_check", F.explode(F.arrays_zip("seeds", "places")).alias("at")).select("_hash", "_check", F.col("at.seeds").alias("seed"), F.col("at.places").alias("here")).distinct()
    hits = placed.join(seeds, "seed").select("_hash", "_check", "item", (F.col("here") - F.col("place")).alias("shift"))
    near = hits.groupBy("_hash", "_check", "item").agg(F.collect_set("shift").alias("shifts")).join(items, "item")
    near = near.groupBy("_hash", "_check").agg(F.collect_list(F.struct("item_id", "item_text", "shifts")).alias("near"))
    texts = suspects.groupBy("_hash", "_check").agg(F.any_value("text").alias("text"))
    found = texts.join(near, ["_hash", "_check"]).mapInArrow(_verified, f"_hash long, _check int, overlaps {OVERLAPS}")
    return stored(found.filter(F.size("overlaps") > 0), "overlaps")


def _same_text(docs: DataFrame, found: DataFrame) -> F.Column:
    keys = text_keys(docs["text"])
    return (keys["_hash"] == found["_hash"]) & (keys["_check"] == found["_check"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs and `overlaps`: an array of (item_id, n_equal, first_word, end_word), by item."""
    docs, found = docs.drop("overlaps"), text_overlaps(docs, benchmark)
    joined = docs.join(found, _same_text(docs, found), "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce(found["overlaps"], F.array().cast(OVERLAPS)).alias("overlaps"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose texts have no overlap."""
    found = text_overlaps(docs, benchmark)
    return docs.join(found, _same_text(docs, found), "left_anti")
