"""Sums of a long vector over all rows of a table, which meet in blocks and in two steps: no task gets them whole."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Numbers of a block, and shares of the tasks that meet first.
BLOCK, MEET = 16_384, 32


def _added(table: pa.Table) -> pa.Table:
    total = np.sum(np.stack([np.frombuffer(v.as_buffer()) for v in table.column("sums")]), axis=0)
    return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(batch), a vector of `size` numbers, over the batches of all rows; a pass over the table."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        blocks = [total[at : at + BLOCK].tobytes() for at in range(0, size, BLOCK)]
        share = TaskContext.get().partitionId() % MEET
        yield pa.record_batch([pa.array(range(len(blocks)), pa.int32()), pa.array([share] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["block", "part", "sums"])

    local = rows.mapInArrow(sums, "block int, part int, sums binary")
    met = local.groupBy("block", "part").applyInArrow(_added, "block int, sums binary")
    found = met.groupBy("block").applyInArrow(_added, "block int, sums binary").collect()  # one vector
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.block)]) if found else np.zeros(size)
