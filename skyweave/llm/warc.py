"""WARC archives as a chunked record table.

A payload is stored as segment records of at most CHUNK_BYTES each (the format's own record segmentation): rows of
record identifier and chunk number, so no step needs room for a whole record. Spark's text writer writes each row as
one record; the two line ends that close a record are its separator, and the parts are gzipped (a member a part, as
Spark's writer has it, so a part is read from its start). On reading, each archive part (of bounded size, as its records
are) is split into records by their content lengths, and the digest of a payload is carried along its chunks in order.
Records of equal payloads from LEAST_SHARED bytes on are revisits of the one with the largest id. Equal payloads meet
as digests and ids alone; a record is named by its page, its digest, and its number among equal ones.

Cases: a null payload is empty; null ids get no revisits and are written with an empty id; rows that repeat an id are
numbered apart; an empty table writes no records; other columns are ignored.
"""

import gzip
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BYTES, LEAST_SHARED = 65_536, 1_000
#: Records of an archive part, which with CHUNK_BYTES bounds what a reader holds of it.
PART_RECORDS = 1_024
END = "\r\n\r\n"
RECORD = "record_id string, page_id long, chunk_no int, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk binary"


def _name(page: int | None, digest: str, number: int, segment: int) -> str:
    return f"<urn:page:{'' if page is None else page}:sha1:{digest}:{number}:{segment}>"


def _records(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each segment: headers and chunk, as text bytes."""
        for batch in batches:
            numbers, pages, urls, refers, digests, sizes = (batch.column(c).to_pylist() for c in ("number", "page_id", "url", "refers_to", "digest", "bytes"))
            out: list[bytes] = []
            held = 0
            for i, payload in enumerate(batch.column("html")):
                raw = payload.as_buffer() if payload.is_valid else b""
                view = memoryview(raw)
                revisit = refers[i] is not None
                head = [
                    f"WARC-Date: {date}",
                    f"WARC-Target-URI: {(urls[i] or '').translate({10: None, 13: None})}",
                    f"WARC-Payload-Digest: sha1:{digests[i]}",
                    f"Page-Id: {'' if pages[i] is None else pages[i]}",
                    f"Payload-Length: {sizes[i]}",
                    "Content-Type: text/html; charset=utf-8",
                    *([f"WARC-Refers-To: {_name(refers[i], digests[i], 1, 1)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
                ]
                chunks = 1 if revisit else max(1, -(-len(view) // CHUNK_BYTES))
                for k in range(chunks):
                    part = b"" if revisit else view[k * CHUNK_BYTES : (k + 1) * CHUNK_BYTES]
                    segment = [f"WARC-Segment-Number: {k + 1}"] if chunks > 1 else []
                    if k:
                        segment.append(f"WARC-Segment-Origin-ID: {_name(pages[i], digests[i], numbers[i], 1)}")
                    if k and k == chunks - 1:
                        segment.append(f"WARC-Segment-Total-Length: {sizes[i]}")
                    kind = "revisit" if revisit else "continuation" if k else "response"
                    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(pages[i], digests[i], numbers[i], k + 1)}", *segment, *head, f"Content-Length: {len(part)}", "", ""]
                    out.append("\r\n".join(lines).encode() + bytes(part))
                    held += len(part)
                if held > 8_000_000:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    return run


def write_archives(pages: DataFrame, path: str, part_records: int = PART_RECORDS, date: str | None = None) -> None:
    """Writes one logical record for each row of pages (page_id, url, html) below `path`; `date`: when they were captured
    (now, if not given), as 2025-01-31T00:00:00Z."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"))
    facts = {"bytes": F.octet_length("html").cast("long"), "digest": F.sha1("html"), "key": F.sha2("html", 256)}
    large = rows.filter((F.octet_length("html") >= LEAST_SHARED) & F.col("page_id").isNotNull()).select("page_id", facts["key"].alias("key"))
    same = large.groupBy("key").agg(F.max("page_id").alias("original"), F.min("page_id").alias("least")).filter("least < original")
    revisits = large.join(same, "key").filter("page_id < original").select("page_id", "key", F.col("original").alias("refers_to")).distinct()
    placed = rows.withColumns(facts).join(revisits, ["page_id", "key"], "left")
    number = F.row_number().over(Window.partitionBy("page_id", "key").orderBy("url"))
    records = placed.select(number.alias("number"), "page_id", "url", "refers_to", "digest", "bytes", "html").mapInArrow(_records(date), "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", part_records).text(path)


def parse(archive: memoryview) -> Iterator[tuple[dict[str, str], memoryview]]:
    """The records of an archive part: headers and a view of the block."""
    raw, at = archive.obj if isinstance(archive.obj, bytes) else bytes(archive), 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(headers["Content-Length"])
        block = archive[stop + 4 : stop + 4 + size]
        if len(block) != size or raw[stop + 4 + size : stop + 8 + size] != END.encode():
            raise ValueError(f"a record at byte {at} is cut off")
        yield headers, block
        at = stop + 8 + size


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for headers, block in parse(memoryview(gzip.decompress(content.as_py()))):
                refers = headers.get("WARC-Refers-To")
                page = headers["Page-Id"].strip()
                rows.append((headers.get("WARC-Segment-Origin-ID", headers["WARC-Record-ID"]), int(page) if page else None, int(headers.get("WARC-Segment-Number", 1)), headers["WARC-Type"], int(refers.split(":")[2]) if refers else None, int(headers["Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), bytes(block)))
                held += len(block)
                if held > 8_000_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of archives: (record_id, page_id, chunk_no, ...), the bytes of one chunk a row."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(_parsed, RECORD)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Carries a digest along the chunks of each record, which come one after another; one row a record."""
    now, head, digest, size = None, None, None, 0
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def close() -> tuple:
        page, kind, refers, told, told_digest = head
        if kind != "revisit" and (size, digest.hexdigest()) != (told, told_digest):
            raise ValueError(f"payload of page {page} does not match its digest")
        return page, told, told_digest, kind, refers

    for batch in batches:
        rows = []
        columns = [batch.column(c).to_pylist() for c in ("record_id", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")]
        for record, page, kind, refers, told, told_digest, chunk in zip(*columns, batch.column("chunk")):
            if record != now:
                if head:
                    rows.append(close())
                now, head, digest, size = record, (page, kind, refers, told, told_digest), hashlib.sha1(), 0
            view = chunk.as_buffer()
            digest.update(view)
            size += view.size
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names)
    if head:
        yield pa.record_batch([pa.array([v], t) for v, t in zip(close(), types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, digests checked on the way."""
    chunks = read_chunks(spark, path).withColumn("whole", (F.col("chunk_no") == 1) & ((F.col("payload_bytes") <= CHUNK_BYTES) | (F.col("record_type") == "revisit")))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    alone = chunks.filter("whole").drop("whole").mapInArrow(_digested, schema)
    long = chunks.filter("not whole").drop("whole").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_digested, schema)
    return alone.union(long)
