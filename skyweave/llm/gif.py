"""GIF media columns: frames of a GIF by its own rules, and payloads stored as GIF samples.

The decoder reads the blocks of a file, unpacks the LZW code streams of its images, maps indexes by the local or global
palette, and composes timed frames by disposal method and transparent index. Code widths depend only on how many codes
came since the last clear code, so all codes of one width are unpacked at once. The encoder compresses: its table grows
to TABLE entries, then a clear code starts it anew. A long payload takes several frames, each a stream of its own.

Cases: a null text is an empty payload (64 zero bytes); a cut or broken file raises; a null file has no row; repeated
rows each get a row; equal texts give equal files; an empty table gives no rows; other columns are ignored.
"""

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, FRAME_ROWS, DELAY = 64, 4096, 10
CLEAR, STOP, TABLE = 256, 257, 4096
BINS = 8


@dataclass
class Frame:
    delay: int
    pixels: np.ndarray  # of the composed canvas: rows, columns, RGB
    indexes: np.ndarray  # of the stored image


def widths(n: np.ndarray, least: int) -> np.ndarray:
    """The bits of the code that comes after n others since the last clear code."""
    return np.clip(np.ceil(np.log2(n + (1 << least) + 2)).astype(np.int64), least + 1, 12)


def code_stream(samples: bytes) -> bytes:
    """The compressed code stream of 8-bit samples."""
    codes, table, size = [CLEAR], {}, STOP + 1
    rest = iter(samples)
    now = next(rest, -1)
    for b in rest:
        key = now << 8 | b
        longer = table.get(key)
        if longer is not None:
            now = longer
            continue
        codes.append(now)
        now = b
        table[key] = size
        size += 1
        if size == TABLE:
            codes.append(CLEAR)
            table, size = {}, STOP + 1
    codes += [now, STOP] if now >= 0 else [STOP]
    flat = np.array(codes, np.uint16)
    at = np.arange(len(flat))
    last = np.maximum.accumulate(np.where(flat == CLEAR, at, 0))
    bits = widths(at - np.r_[0, last[:-1]] - 1, 8)
    bits[0] = 9
    places = np.arange(12)
    return np.packbits(((flat[:, None] >> places) & 1).astype(np.uint8)[places < bits[:, None]], bitorder="little").tobytes()


def blocks(data: bytes) -> bytes:
    full = len(data) // 255
    out = np.empty((full, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF of grey frames WIDTH wide whose samples are the payload's bytes (a multiple of WIDTH, not empty)."""
    rows = len(payload) // WIDTH
    height = min(rows, FRAME_ROWS)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), grey]
    for top in range(0, rows, FRAME_ROWS):
        n = min(FRAME_ROWS, rows - top)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08", blocks(code_stream(payload[top * WIDTH : (top + n) * WIDTH]))]
    return b"".join([*out, b"\x3b"])


def unpack_run(bits: np.ndarray, at: int, least: int) -> tuple[np.ndarray, int, int]:
    """The codes from bit `at` up to a clear or stop code; that code, and the bit after it."""
    clear, got, n = 1 << least, [], 0
    width = least + 1
    while True:
        # the table holds clear + 1 + n entries when code n is read, so this many codes have this width
        room = max(1, (1 << width) - clear - 1 - n) if width < 12 else 1 << 12
        there = (len(bits) - at) // width
        if there <= 0:
            raise ValueError("a code stream is cut off")
        take = min(room, there)
        codes = bits[at : at + take * width].reshape(take, width) @ (1 << np.arange(width, dtype=np.int32))
        end = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(end):
            k = int(end[0])
            got.append(codes[:k])
            return np.concatenate(got), int(codes[k]), at + (k + 1) * width
        got.append(codes)
        n += take
        at += take * width
        width = min(12, width + 1)


def expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """What the codes of one run stand for.

    The entry that a code adds is its own string and the next sample, so it stands in the output where the code does:
    a code of the table copies from there. Lengths and sources are followed by pointer jumping, all codes at once.
    """
    at = np.arange(len(codes))
    base = np.where(codes > clear, codes - (clear + 2), -1)  # the code that added the entry
    if (base >= at).any():
        raise ValueError("a code stream has an unknown code")
    size, up = np.ones(len(codes), np.int64), base
    while (up >= 0).any():
        size = size + np.where(up >= 0, size[up], 0)
        up = np.where(up >= 0, up[up], -1)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[begin[base < 0]] = codes[base < 0]
    source = np.arange(len(out)) - np.repeat(np.where(base < 0, 0, begin - begin[base]), size)
    while True:
        further = source[source]
        if (further == source).all():
            return out[source]
        source = further


def lzw(data: bytes, least: int, size: int) -> np.ndarray:
    """The indexes of a code stream, `size` of them."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear, at, out, have, stop = 1 << least, 0, [], 0, False
    while have < size and not stop:
        codes, ended, at = unpack_run(bits, at, least)
        out.append(expand(codes, clear))
        have += len(out[-1])
        stop = ended == clear + 1
    indexes = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(indexes) < size:
        raise ValueError("an image has too few samples")
    return indexes[:size]


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(out), at + 1


def frames(data: bytes) -> Iterator[Frame]:
    """The frames of a file, each as shown."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        common = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 3), np.uint8)
    ground = common[back] if common is not None and back < len(common) else np.zeros(3, np.uint8)
    canvas[:] = ground
    delay, disposal, clear_index = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                control, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, clear_index = control >> 2 & 7, index if control & 1 else None
            _, at = _sub_blocks(data, at + 2)
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block at byte {at}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        stream, after = _sub_blocks(data, at + 1)
        indexes = lzw(stream, data[at], w * h).reshape(h, w)
        at = after
        if flags & 0x40:  # interlaced: rows come in four passes
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            plain = np.empty_like(indexes)
            plain[order] = indexes
            indexes = plain
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = indexes[: area.shape[0], : area.shape[1]]
        colours = palette[np.minimum(shown, len(palette) - 1)]
        area[:] = colours if clear_index is None else np.where((shown == clear_index)[:, :, None], area, colours)
        yield Frame(delay * 10, canvas.copy(), indexes)
        if disposal == 2:
            canvas[top : top + h, left : left + w] = ground
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index = 0, 0, None


def histogram(pixels: np.ndarray) -> list[int]:
    """Pixels by brightness of red, green and blue, in BINS bins each."""
    return [int(n) for c in range(3) for n in np.bincount(pixels[:, :, c].ravel() // (256 // BINS), minlength=BINS)]


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, media, sizes, held = [], [], [], 0
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw = text.as_py().encode() if text.is_valid else b""
            payload = raw + bytes((-len(raw)) % WIDTH or (0 if raw else WIDTH))
            ids.append(i)
            sizes.append(len(raw))
            media.append(encode(payload))
            held += len(payload)
            if held > 4_000_000:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                ids, media, sizes, held = [], [], [], 0
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as the samples of a GIF."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


FRAMES = "array<struct<frame:int,delay_ms:int,width:int,height:int,histogram:array<bigint>>>"
_FRAMES = pa.list_(pa.struct([("frame", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), _FRAMES]
    for batch in batches:
        rows = []
        for i, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media")):
            if not data.is_valid:
                continue
            raw, tail, size, shown, media = hashlib.sha256(), b"", 0, [], data.as_py()
            for k, f in enumerate(frames(media)):
                part = f.indexes.tobytes()
                raw.update(part)
                size += len(part)
                tail = part[-64:]
                shown.append({"frame": k, "delay_ms": f.delay, "width": f.pixels.shape[1], "height": f.pixels.shape[0], "histogram": histogram(f.pixels)})
            rows.append((i, n, size, raw.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), shown))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


def decode(media: DataFrame) -> DataFrame:
    """Each file of column `media` read back: digests of its samples, and its timed frames with colour histograms."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames " + FRAMES
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decoded, schema)


def frame_table(decoded: DataFrame) -> DataFrame:
    """(doc_id, frame, delay_ms, width, height, histogram): a row for each timed frame."""
    return decoded.select("doc_id", F.inline("frames"))


def feature(frames_column: str = "frames") -> F.Column:
    """The frames as a string: time and histogram of each."""
    return F.array_join(F.transform(frames_column, lambda f: F.concat(f["delay_ms"].cast("string"), F.lit("ms:"), F.array_join(F.transform(f["histogram"], lambda n: n.cast("string")), ","))), ";")
