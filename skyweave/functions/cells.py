"""Pairs of a feature table without all pairs: cells around pivots, ruled out by the triangle inequality.

Some rows are pivots; every row belongs to the cell of its nearest one. A row that looks for others within its reach is
sent only to cells that may hold some: by the cell's radius, and as a row of another cell is nearer to its own pivot.
Cells that lie together form groups of BLOCK_ROWS members: a task gets those of a group (of a larger cell, a block) and
some of the rows sent there, forms their distances a tile at a time (in single precision, where pairs near a limit are then
taken again), and reduces each tile at once. Groups, blocks and
shares of rows sent bound the memory of a task, whatever a cell holds; where nothing is ruled out, a row is sent to as many
tasks as there are groups, not cells.
Pivots go to all tasks: PIVOT_BYTES bounds them. A metric without triangle inequality has one cell.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import stored
from .metrics import Metric
from .pairs import BLOCK_ROWS, LEAST_ROWS, TILE_ROWS, Exact, tile_rows
from .sums import summed

#: Rows a cell, about, as long as the pivots fit; tasks a core, about, that the rows sent are dealt to.
CELL_ROWS, WAVES = 2_000, 2
PIVOT_BYTES = 32 << 20


@dataclass
class Cells:
    """table: (key, features prepared, cell, extra columns), stored; radius and size of each cell by number."""

    table: DataFrame
    key: str
    metric: Metric
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    extra: tuple[str, ...]


def stacked(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1))


def cells_of(features: DataFrame, metric: Metric, key: str = "obj_id", extra: tuple[str, ...] = (), cell_rows: int | None = None) -> Cells:
    rows = features.select(F.col(key).cast("long").alias(key), "features", *extra)
    n, width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
    wanted = min(n // (cell_rows or CELL_ROWS), PIVOT_BYTES // (8 * max(width or 1, 1)))
    if metric.triangle and wanted > 1:
        picked = rows.select(key, "features").orderBy(F.xxhash64(key), key).limit(int(wanted)).collect()  # PIVOT_BYTES at most
        pivots = np.unique(metric.prepared(np.array([r.features for r in picked], float)), axis=0)
    else:
        pivots = np.zeros((1, width or 1))
    shared = features.sparkSession.sparkContext.broadcast(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = metric.prepared(stacked(batch.column("features")).astype(float))
            cell, away = np.zeros(len(x), np.int32), np.zeros(len(x))
            if len(shared.value) > 1:
                for at in range(0, len(x), TILE_ROWS):
                    part = x[at : at + TILE_ROWS]
                    cell[at : at + TILE_ROWS] = metric.tile(part, shared.value).argmin(1)
                away = metric.pairs(x, shared.value[cell])
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)), pa.array(x.ravel() if len(x) else np.zeros(0)))
            yield pa.record_batch([batch.column(key), vectors, pa.array(cell), pa.array(away), *(batch.column(c) for c in extra)], [key, "features", "cell", "away", *extra])

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{key} long, features array<double>, cell int, away double", *(f"{c} {kinds[c]}" for c in extra)])
    table = stored(rows.mapInArrow(dealt, schema), "cells")
    radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), int)
    for r in table.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect():  # a row a pivot
        radius[r.cell], size[r.cell] = r.radius, r.n
    return Cells(table, key, metric, pivots, radius, size, extra)


def reached(cells: Cells, queries: DataFrame, least: int = 0, others: bool = False) -> DataFrame:
    """queries with `to`: the cells that may hold a row within `reach` (null: as far as `least` other rows are sure)."""
    if len(cells.pivots) == 1:
        return queries.withColumn("to", F.array(F.lit(0)) if not others else F.array().cast("array<int>"))
    metric, shared = cells.metric, queries.sparkSession.sparkContext.broadcast((cells.pivots, cells.radius, cells.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radius, size = shared.value
        for batch in batches:
            x, own = stacked(batch.column("features")), batch.column("cell").to_numpy()
            reach = batch.column("reach").to_numpy(zero_copy_only=False).astype(float)
            to: list[np.ndarray] = []
            for at in range(0, len(x), TILE_ROWS):
                part = slice(at, at + TILE_ROWS)
                d = metric.tile(x[part], pivots)
                slack = Exact(x[part], pivots, metric).slack
                far = reach[part].copy()
                for i in np.flatnonzero(np.isnan(far)):
                    order = np.argsort(d[i] + radius)
                    sure = np.searchsorted(np.cumsum(size[order]), least + 1)
                    far[i] = (d[i] + radius)[order[sure]] if sure < len(order) else np.inf
                low = np.maximum(d - radius, (d - d[np.arange(len(d)), own[part]][:, None]) / 2)
                near = (low <= (far * (1 + 1e-12))[:, None] + 2 * slack) & (size > 0)
                near[np.arange(len(d)), own[part]] = ~np.bool_(others) & (size[own[part]] > 0)
                to += [np.flatnonzero(r).astype(np.int32) for r in near]
            lengths = np.cumsum([0, *map(len, to)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(to) if to else np.zeros(0, np.int32)))
            yield batch.append_column("to", lists)

    schema = ", ".join(f"{c} {k}" for c, k in queries.dtypes)
    return queries.mapInArrow(run, f"{schema}, to array<int>")


def gathered(cells: Cells) -> np.ndarray:
    """Number of the group that each cell belongs to: neighbouring cells of BLOCK_ROWS members together, at most."""
    out, n = np.zeros(len(cells.size), np.int32), 0
    left = [np.arange(len(cells.size))]
    while left:
        part = left.pop()
        if len(part) == 1 or cells.size[part].sum() <= BLOCK_ROWS:
            out[part], n = n, n + 1
            continue
        order = part[np.argsort(cells.pivots[part, cells.pivots[part].var(0).argmax()], kind="stable")]
        total = np.cumsum(cells.size[order])
        at = int(np.clip(np.searchsorted(total, total[-1] / 2), 1, len(part) - 1))
        left += [order[:at], order[at:]]
    return out


def searched(cells: Cells, sent: DataFrame, reduce: Callable, schema: str, apart: bool = False) -> DataFrame:
    """reduce(own, others, distances, exact) -> DataFrame for each tile of rows sent and members of cells.

    sent: rows of the cells' columns and `to`, an array of cells; own and others are pandas frames without the features, the
    index of others is their place in `exact.memo["ids"]`. A row goes once to each
    group of cells that it is sent to, however many of these it names. A tile's members are those of all cells that one of
    its rows names: a row meets every member that it is sent to, once, and may meet some of the group that it is not.
    apart: each cell is a group, for rows that go to one cell."""
    spark, key, metric = cells.table.sparkSession, cells.key, cells.metric
    rows, group = stored(sent, "sent"), np.arange(len(cells.size), dtype=np.int32) if apart else gathered(cells)
    shared, groups = spark.sparkContext.broadcast(group), int(group.max(initial=0)) + 1

    def met(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, group and first place of each pair of a row and a group; the cells in that order."""
        to, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((shared.value[to], row))
        row, to = row[order], to[order]
        of = shared.value[to]
        first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (of[1:] != of[:-1])][: len(row)])
        return row[first], of[first], first, to

    n = summed(rows.select("to"), lambda batch: np.bincount(met(batch.column("to"))[1], minlength=groups).astype(float), groups)
    if not n.any():
        return spark.createDataFrame([], schema)
    members = np.bincount(group, cells.size, groups)
    share = max(LEAST_ROWS, min(BLOCK_ROWS, int(n.sum()) // (WAVES * spark.sparkContext.defaultParallelism) + 1))
    blocks, shares = np.ceil(members / BLOCK_ROWS).astype(int), np.ceil(n / share).astype(int)
    table = F.broadcast(spark.createDataFrame([(int(g), int(blocks[g]), int(shares[g])) for g in np.flatnonzero(n)], "to int, blocks int, shares int"))
    of_cell = F.broadcast(spark.createDataFrame([(c, int(g)) for c, g in enumerate(group) if n[g]], "cell int, to int"))  # a row a pivot

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, of, first, to = met(batch.column("to"))
            named = pa.ListArray.from_arrays(pa.array(np.r_[first, len(to)].astype(np.int32)), pa.array(to.astype(np.int32)))
            for at in range(0, len(row), 1000):
                part = slice(at, at + 1000)
                own = batch.drop_columns(["to"]).take(pa.array(row[part]))
                yield own.append_column("to", pa.array(of[part].astype(np.int32))).append_column("named", named[part])

    kinds = [f"{c} {k}" for c, k in rows.dtypes if c != "to"]
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = rows.mapInArrow(dealt, ", ".join([*kinds, "to int", "named array<int>"])).join(table, "to")
    own = own.withColumns({"part": F.pmod(F.xxhash64(key, "to"), F.col("shares")).cast("int"), "block": F.explode(each("blocks"))}).drop("blocks", "shares")
    others = cells.table.join(of_cell, "cell").join(table, "to").withColumns({"block": F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"), "part": F.explode(each("shares"))}).drop("blocks", "shares")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return reduce(a.iloc[:0], b.iloc[:0], np.zeros((0, 0)), None)
        a, b = a.sort_values(["cell", key]), b.sort_values(key, ignore_index=True)
        x, y, cell = np.stack(a["features"].to_numpy()), np.stack(b["features"].to_numpy()), b["cell"].to_numpy()
        named, at, out, memo = a["named"].to_numpy(), 0, [], {"ids": b[key].to_numpy()}
        a, b = a.drop(columns=["features", "named"]), b.drop(columns="features")
        while at < len(x):
            wanted = np.isin(cell, np.unique(np.concatenate(named[at : at + TILE_ROWS])))
            rows = tile_rows(int(wanted.sum()))
            if rows < TILE_ROWS:
                wanted = np.isin(cell, np.unique(np.concatenate(named[at : at + rows])))
            mine, theirs = (b, y) if wanted.all() else (b[wanted], y[wanted])
            part = x[at : at + rows]
            if len(mine):
                d, slack = metric.quick(part, theirs, memo)
                out.append(reduce(a.iloc[at : at + rows], mine, d, Exact(part, theirs, metric, memo, slack)))
            at += rows
        return pd.concat(out, ignore_index=True) if out else reduce(a.iloc[:0], b.iloc[:0], np.zeros((0, 0)), None)

    by = ["to", "block", "part"]
    return own.groupBy(*by).cogroup(others.groupBy(*by)).applyInPandas(run, schema)


def compared(cells: Cells, sent: DataFrame) -> int:
    """How many pairs the rows sent ask for; tiles of rows that ask for different cells are compared in some more."""
    counts = sent.select(F.explode("to").alias("to")).groupBy("to").agg(F.count("*").alias("n")).collect()
    return int(sum(r.n * int(cells.size[r.to]) for r in counts))


def within(cells: Cells, radius: float) -> DataFrame:
    """All rows, each sent to the cells that may hold rows within a radius."""
    return reached(cells, cells.table.withColumn("reach", F.lit(float(radius))))
