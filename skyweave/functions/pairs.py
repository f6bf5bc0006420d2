"""Blocked pairs: all pairs of a feature table without a row for each pair.

Rows are dealt to blocks by a hash of the id. A task gets two blocks, forms their distances TILE_ROWS rows at a time by
matrix products, and reduces each tile at once: to the nearest k, to counts and links within a radius, or to sums by
cluster. Blocks of BLOCK_ROWS rows bound the memory of a task; every row is sent to as many tasks as there are blocks.
Matrix products lose digits near zero: what lies near a limit is taken again from differences.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import Metric

EUCLID = Metric("euclidean")
BLOCK_ROWS, TILE_ROWS, LEAST_ROWS = 20_000, 500, 500
#: Numbers of a tile, at most: what a task's reduction copies is a few times as much.
TILE_NUMBERS = 2_000_000


def tile_rows(columns: int) -> int:
    """Rows of a tile that has so many columns."""
    return max(1, min(TILE_ROWS, TILE_NUMBERS // max(columns, 1)))


class Exact:
    """Distances of some pairs of a tile from their differences; `slack`: how far those of the tile may be off; `memo`: what a
    reduction keeps from one tile of a task to the next."""

    def __init__(self, x: np.ndarray, y: np.ndarray, metric: Metric = EUCLID, memo: dict | None = None, slack: float | None = None):
        self.x, self.y, self.metric, self.memo = x, y, metric, {} if memo is None else memo
        if slack is not None:
            self.slack = slack
            return
        self.slack = 1e-6 * float(np.sqrt(max(np.abs(x).max(), np.abs(y).max()) ** 2 * x.shape[1])) if metric.euclidean and x.size and y.size else 0.0

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [self.metric.pairs(self.x[i[s : s + 65536]], self.y[j[s : s + 65536]]) for s in range(0, len(i), 65536)]
        return np.concatenate(parts) if parts else np.zeros(0)


def blocked(features: DataFrame, reduce: Callable, schema: str, key: str = "obj_id", extra: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """reduce(own, others, distances, exact) -> DataFrame for tiles of each pair of blocks, in both directions.

    own and others are pandas frames with the extra columns; within one block both are the same rows.
    """
    n = features.count()
    wanted = int(np.ceil(np.sqrt(2 * features.sparkSession.sparkContext.defaultParallelism)))
    blocks = max(1, -(-n // block_rows), min(wanted, n // LEAST_ROWS))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = features.select(key, "features", *extra, own.alias("block"))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"i": low, "j": high})

    def tiles(a: pd.DataFrame, b: pd.DataFrame) -> list[pd.DataFrame]:
        x, y = (np.stack(side["features"].to_numpy()) if len(side) else np.zeros((0, 1)) for side in (a, b))
        if not len(x) or not len(y):
            return [reduce(a.iloc[:0], b.iloc[:0], np.zeros((0, 0)), Exact(x[:0], y[:0]))]
        out = []
        rows = tile_rows(len(y))
        for at in range(0, len(x), rows):
            part = x[at : at + rows]
            out.append(reduce(a.iloc[at : at + rows], b, EUCLID.tile(part, y), Exact(part, y)))
        return out

    def run(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        a = part[part["block"] == i].sort_values(key)
        if i == j:
            return pd.concat(tiles(a, a), ignore_index=True)
        b = part[part["block"] == j].sort_values(key)
        return pd.concat([*tiles(a, b), *tiles(b, a)], ignore_index=True)

    return dealt.groupBy("i", "j").applyInPandas(run, schema)
