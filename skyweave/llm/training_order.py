"""Training-order materialisation: token sequences in a keyed pseudo-random order, as fixed-stride binary shards.

Each sequence has a number, (doc_id - least doc_id) * most sequences of a text + its place in the text. A keyed Feistel
network, cycle-walked to the numbers that exist, permutes them; equal ranges of the permuted numbers are the shards, in
which sequences stand in that order. A global slot is the count of sequences before: those of earlier shards (known
from file lengths, as the stride is fixed) and those earlier in the shard. One pass tokenises, one exchange deals.

A record is HEADS (doc_id, place in the text, number of ids), LENGTH little-endian 16-bit ids filled up with the end id,
and two zero bytes, which Spark's text writer puts between records: record n of a shard starts at n * stride.

Cases: null text is empty and yields its end id alone; rows that repeat a doc_id share numbers and stand by doc_id and
text; a null doc_id counts as the largest and is read back as null; an empty table writes nothing; other columns are
ignored; ids over 16 bits raise.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .token_ids import encode
from .words import mix, slices

LENGTH, END, ROUNDS = 256, 1, 6
#: Bytes of text that a shard holds the ids of, about.
SHARD_TEXT_BYTES = 8_000_000
HEADS = np.dtype([("doc", "<i8"), ("place", "<i4"), ("n", "<i4")])
SEPARATOR = "\0\0"
STRIDE = HEADS.itemsize + 2 * LENGTH + len(SEPARATOR)
NO_ID = np.iinfo(np.int64).max
MOST = 1 << 62


def feistel(numbers: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size), at the given numbers."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = numbers.astype(np.uint64)
    walk = np.arange(len(out))
    while len(walk):  # numbers beyond the end are permuted on until they fall inside
        left, right = out[walk] >> shift, out[walk] & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walk] = (left << shift) | right
        walk = walk[out[walk] >= np.uint64(size)]
    return out.astype(np.int64)


def _sequences(batches: Iterator[pa.RecordBatch], path: str, low: int, most: int, size: int, shards: int, key: int) -> Iterator[pa.RecordBatch]:
    width = -(-size // shards)
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            ids, offsets = encode(part.column("text"), path)
            if len(ids) and ids.max() > 0xFFFF:
                raise ValueError("ids over 16 bits")
            docs = part.column("doc_id").fill_null(NO_ID).to_numpy()
            counts = np.diff(offsets) // LENGTH + 1  # with the end id
            row = np.repeat(np.arange(len(docs)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            base = np.where(docs == NO_ID, size // most - 1, (docs - low) % (MOST // most))
            order = feistel(base[row] * most + place, size, key)
            flat = np.full(len(row) * LENGTH, END, "<u2")  # a text's ids stand one after another in its rows
            begin = (np.cumsum(counts) - counts) * LENGTH
            flat[np.repeat(begin - offsets[:-1], np.diff(offsets)) + np.arange(len(ids))] = ids
            heads = np.empty(len(row), HEADS)
            heads["doc"], heads["place"] = docs[row], place
            heads["n"] = np.minimum(LENGTH, np.diff(offsets)[row] + 1 - place * LENGTH)
            records = np.concatenate([heads.view(np.uint8).reshape(len(row), -1), flat.view(np.uint8).reshape(len(row), -1)], 1)
            bounds = (np.arange(len(row) + 1) * records.shape[1]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(records)])
            yield pa.record_batch([pa.array((order // width).astype(np.int32)), pa.array(order), binary], ["shard", "order", "record"])


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: int, shard_bytes: int = SHARD_TEXT_BYTES) -> None:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.octet_length("text")
    low, high, longest, total = texts.agg(F.min("doc_id"), F.max("doc_id"), F.max(size), F.sum(size)).first()
    most = (longest or 0) // LENGTH + 1  # a token has a byte at least
    numbers = min(((high or 0) - (low or 0) + 2) * most, MOST // most * most)
    shards = min(numbers, max(1, -(-(total or 0) // shard_bytes)))
    rows = texts.mapInArrow(lambda batches: _sequences(batches, tokenizer, low or 0, most, numbers, shards, key), "shard int, order long, record binary")
    dealt = rows.repartition(int(shards), "shard").sortWithinPartitions("shard", "order", "record")
    dealt.select("shard", F.col("record").cast("string").alias("value")).write.option("lineSep", SEPARATOR).partitionBy("shard").text(path)


def _records(batches: Iterator[pa.RecordBatch], with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, before, content in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), batch.column("content")):
            raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, STRIDE)
            heads = raw[:, : HEADS.itemsize].copy().view(HEADS).ravel()
            view = memoryview(raw.ravel())
            starts = np.arange(len(heads)) * STRIDE + HEADS.itemsize
            ids = [view[a:b] for a, b in zip(starts.tolist(), (starts + 2 * heads["n"]).tolist())]
            row = np.arange(len(heads), dtype=np.int64)
            columns = [pa.array(before + row), pa.array(np.full(len(row), shard, np.int32)), pa.array(row), pa.array(heads["doc"].copy(), mask=heads["doc"] == NO_ID), pa.array(heads["place"].astype(np.int32)), pa.array(heads["n"].astype(np.int32)), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
            names = ["slot", "shard", "row", "doc_id", "place", "n_ids", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([i.tobytes() for i in ids], pa.binary())], [*names, "ids"]
            yield pa.record_batch(columns, names)


def read_shards(spark: SparkSession, path: str, first_shard: int = 0, with_ids: bool = True) -> DataFrame:
    """(slot, shard, row, doc_id, place, n_ids, ids_crc32, ids) from `first_shard` on, where an earlier reading stopped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.regexp_extract("path", r"shard=(\d+)/", 1).cast("int").alias("shard"), "length", "content")
    lengths = files.groupBy("shard").agg((F.sum("length") / STRIDE).cast("long").alias("n"))
    many = lengths.withColumn("block", F.shiftright("shard", 12))  # slots are summed in blocks of shards
    blocks = many.groupBy("block").agg(F.sum("n").alias("all"))
    blocks = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("start"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("shard")) - F.col("n")
    before = many.withColumn("inside", inside).join(blocks, "block").select("shard", (F.col("start") + F.col("inside")).alias("before"))
    rows = files.filter(F.col("shard") >= first_shard).select("shard", "content").join(before, "shard")
    schema = "slot long, shard int, row long, doc_id long, place int, n_ids int, ids_crc32 long" + ", ids binary" * with_ids
    return rows.select("shard", "before", "content").mapInArrow(lambda batches: _records(batches, with_ids), schema)
