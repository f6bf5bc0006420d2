"""Running values over a sorted table, range by range.

Rows are dealt to sorted ranges; a task reads its range in order, with bounded memory, and adds running values as if its
range were the first. A range ends with one row that sums it up. These rows, one a range, are put in order in the
driver: what came before each range is known from them, and is joined back by the number of the range.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import stored

#: Fixed prime, for sums of products that stay below 64 bits.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_LOW29, _LOW32 = np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo PRIME."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo PRIME of numbers below it, in parts of 32 bits."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle = a1 * b0 + a0 * b1  # below 2**62
    high = a1 * b1 * np.uint64(8) + (middle >> np.uint64(29))  # 2**64 is 8, and 2**61 is 1
    return reduced(reduced(high) + reduced(((middle & _LOW29) << np.uint64(32))) + reduced(a0 * b0))


def running(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums modulo PRIME up to each place, from the place `start` of its segment on."""
    parts = []
    for half in (x >> np.uint64(32), x & _LOW32):
        total = np.r_[np.uint64(0), np.cumsum(half, dtype=np.uint64)]
        parts.append(reduced(total[1:] - total[start]))
    return reduced(times(parts[0], np.full(len(x), 1 << 32, np.uint64)) + parts[1])


def segment_starts(segment: np.ndarray) -> np.ndarray:
    """For each place of a batch, where its segment starts in it."""
    new = np.r_[True, segment[1:] != segment[:-1]][: len(segment)]
    return np.maximum.accumulate(np.where(new, np.arange(len(segment)), 0))


def scanned(df: DataFrame, dealt: list, order: list, step: Callable, schema: str, name: str) -> tuple[DataFrame, list]:
    """Rows of df in `order`, dealt by the first of these columns, through step(batches) -> batches of `schema`.

    step's last batch is a row that sums up its range, told by `_sum` (boolean, in the schema). Returns the stored rows
    with `_range`, and the sums in the order of the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in step(batches):
            yield batch.append_column("_range", pa.array(np.full(batch.num_rows, at, np.int32)))

    rows = stored(df.repartitionByRange(*dealt).sortWithinPartitions(*order).mapInArrow(run, f"{schema}, _sum boolean, _range int"), name)
    return rows.filter("not _sum").drop("_sum"), rows.filter("_sum").orderBy("_range").collect()


def before(rows: DataFrame, carried: list[tuple], schema: str) -> DataFrame:
    """rows joined with what came before their range; `carried`: (_range, ...), a row a range."""
    table = rows.sparkSession.createDataFrame(carried, f"_range int, {schema}")
    return rows.join(F.broadcast(table), "_range", "left").drop("_range")
