"""Nearest neighbours and novelty on feature tables (obj_id, features array<double>)."""

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import BLOCK_ROWS, Cells, cells_of, reached, searched
from ..functions.metrics import metric_of
from ..functions.pairs import Exact
from ..functions.quantiles import quantiles
from ..sources import numbered, stored


def nearest(features: DataFrame, k: int, with_self: bool = False, key: str = "obj_id", metric: str = "minkowski", p: float = 2, cell_rows: int | None = None) -> DataFrame:
    """G1: (obj_id, nb_id, dist, rank): exact k nearest by (distance, id)."""
    way = metric_of(metric, p)
    found = nearest_in(cells_of(features, way, key, cell_rows=cell_rows), k, with_self)
    return found.withColumn("dist", way.shown(F.col("dist")))


def nearest_in(cells: Cells, k: int, with_self: bool = False) -> DataFrame:
    """G1 by distances of prepared rows. Each row looks through its own cell first; how far its k-th there is bounds which
    other cells it is sent to."""
    key = cells.key

    def top(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray, exact: Exact, own: bool) -> pd.DataFrame:
        ids, others = a[key].to_numpy(), b[key].to_numpy()
        if not d.size:
            return pd.DataFrame({"obj_id": ids[:0], "nb_id": others[:0], "dist": np.zeros(0)})
        away = (a["cell"].to_numpy()[:, None] == b["cell"].to_numpy()[None, :]) != own  # met in the other search
        if own and not with_self:
            away |= ids[:, None] == others[None, :]
        d[away] = np.inf
        n = min(k, d.shape[1])
        limit = np.partition(d, n - 1, axis=1)[:, n - 1]
        near = np.flatnonzero(d <= limit[:, None] + 2 * exact.slack)  # few of many: faster than in two dimensions
        i, j = np.divmod(near[np.isfinite(d.ravel()[near])], d.shape[1])
        dist = exact(i, j) if exact.slack else d[i, j]
        order = np.lexsort((others[j], dist, i))
        i, j, dist = i[order], j[order], dist[order]
        first = np.searchsorted(i, np.arange(len(ids)))
        keep = np.arange(len(i)) - first[i] < k
        return pd.DataFrame({"obj_id": ids[i[keep]], "nb_id": others[j[keep]], "dist": dist[keep]})

    schema = "obj_id long, nb_id long, dist double"
    found = searched(cells, cells.table.withColumn("to", F.array("cell")), partial(top, own=True), schema, apart=True)
    if len(cells.pivots) > 1:
        found = stored(found, "own-cell")
        far = found.groupBy(F.col("obj_id").alias(key)).agg(F.when(F.count("*") >= k, F.max("dist")).alias("reach"))
        if cells.size.max() > BLOCK_ROWS:  # several blocks of a cell have each given k
            best = found.withColumn("rank", F.row_number().over(Window.partitionBy("obj_id").orderBy("dist", "nb_id")))
            far = best.filter(F.col("rank") == k).select(F.col("obj_id").alias(key), F.col("dist").alias("reach"))
        queries = cells.table.join(far.hint("merge"), key, "left").select(*cells.table.columns, "reach")
        found = found.unionByName(searched(cells, reached(cells, queries, k, others=True), partial(top, own=False), schema))
    rank = F.row_number().over(Window.partitionBy("obj_id").orderBy("dist", "nb_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def knee_curve(features: DataFrame, k: int, key: str = "obj_id") -> DataFrame:
    """G1: mean distance to the k nearest, the point itself being the first; sorted by whoever draws it."""
    return nearest(features, k, True, key).groupBy("obj_id").agg(F.avg("dist").alias("mean_dist"))


def lof_of(neighbours: DataFrame, *settings: str) -> DataFrame:
    """Local Outlier Factor of a table of (obj_id, nb_id, dist); of each setting by itself, if columns of such are named."""
    kdist = neighbours.groupBy(*settings, "obj_id").agg(F.max("dist").alias("kdist"))
    reach = neighbours.join(kdist.select(*settings, F.col("obj_id").alias("nb_id"), "kdist"), [*settings, "nb_id"])
    lrd = reach.groupBy(*settings, "obj_id").agg((1 / (F.avg(F.greatest("kdist", "dist")) + 1e-10)).alias("lrd"))
    around = neighbours.join(lrd.select(*settings, F.col("obj_id").alias("nb_id"), F.col("lrd").alias("nb_lrd")), [*settings, "nb_id"]).groupBy(*settings, "obj_id").agg(F.avg("nb_lrd").alias("nb_lrd"))
    return around.join(lrd, [*settings, "obj_id"]).select(*settings, "obj_id", (F.col("nb_lrd") / F.col("lrd")).alias("lof"))


def local_outlier_factor(features: DataFrame, k: int = 20, key: str = "obj_id", metric: str = "minkowski", p: float = 2) -> DataFrame:
    """G2 (Breunig 2000), self excluded."""
    return lof_of(nearest(features, k, key=key, metric=metric, p=p))


def contaminated(scores: DataFrame, share: float) -> DataFrame:
    """Objects at or above the score that a share of all exceeds."""
    scores = stored(scores, "scores")
    cut = quantiles(scores, [], "lof", [1 - share]).select(F.col("quantiles")[0].alias("cut"))
    return scores.join(F.broadcast(cut)).filter("lof >= cut").drop("cut")


def _lof_in_order(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """LOF of sorted values; right for those with 3 * k values (or the end) on both sides."""
    n = len(x)
    at = np.arange(n)[:, None] + np.r_[-k:0, 1 : k + 1][None, :]
    there = (at >= 0) & (at < n)
    at = np.clip(at, 0, n - 1)
    by_id = np.argsort(ids[at], axis=1, kind="stable")
    at, there = np.take_along_axis(at, by_id, 1), np.take_along_axis(there, by_id, 1)
    dist = np.where(there, np.abs(x[at] - x[:, None]), np.inf)
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
    real = np.isfinite(dist)
    many = np.maximum(real.sum(1), 1)
    kdist = np.where(real, dist, -np.inf).max(1)
    reach = np.where(real, np.maximum(kdist[at], dist), 0).sum(1) / many
    lrd = 1 / (reach + 1e-10)
    return np.where(real, lrd[at], 0).sum(1) / many / lrd


def lof_by_feature(features: DataFrame, k: int = 20, key: str = "obj_id", chunk: int = 20_000) -> DataFrame:
    """(dim, obj_id, lof): LOF for every single feature. In one dimension the k nearest lie within k places of the
    sorted order, what their densities need within 3 * k: the order of all (dim, x) is cut into chunks, each with so many
    rows before and after it, so no feature is one task and nothing is joined. An object alone has none."""
    rows = numbered(features.select(F.col(key).alias("obj_id"), F.posexplode("features").alias("dim", "x")), "dim", "x", "obj_id")
    own = F.floor(F.col("number") / chunk)
    reached = F.sequence(F.floor((F.col("number") - 3 * k) / chunk), F.floor((F.col("number") + 3 * k) / chunk))
    dealt = rows.select("dim", "obj_id", "x", "number", own.alias("own"), F.explode(reached).alias("chunk"))

    def run(c: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("number")
        out = [g.assign(lof=_lof_in_order(g["x"].to_numpy(), g["obj_id"].to_numpy(), k)) for _, g in part.groupby("dim") if len(g) > 1]
        every = pd.concat(out) if out else part.assign(lof=0.0).iloc[:0]
        return every[every["own"] == c[0]][["dim", "obj_id", "lof"]]

    return dealt.groupBy("chunk").applyInPandas(run, "dim int, obj_id long, lof double")


def pick(scores: DataFrame, n: int, how: str, seed: int = 0) -> DataFrame:
    """The n most novel, least novel, or n at random (by a seeded hash)."""
    order = {"most": [F.desc("lof"), F.asc("obj_id")], "least": [F.asc("lof"), F.asc("obj_id")], "random": [F.md5(F.concat_ws(":", F.col("obj_id").cast("string"), F.lit(str(seed)))), F.asc("obj_id")]}
    return scores.orderBy(*order[how]).limit(n)


def labelled_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of labelled objects with their label."""
    return scores.join(labels, "obj_id").select("obj_id", "label", "lof")


def rare_class_scores(settings: DataFrame, labels: DataFrame, rare: list) -> DataFrame:
    """Mean score of each rare class for each scan setting; settings has (setting, ..., obj_id, lof)."""
    kinds = [c for c in settings.columns if c not in ("obj_id", "lof")]
    return settings.join(labels.filter(F.col("label").isin(rare)), "obj_id").groupBy(*kinds, "label").agg(F.avg("lof").alias("mean_lof"))


def scan_neighbours(features: DataFrame, ks: list[int], metrics: list[tuple[str, float | None]] = [("minkowski", 2)], key: str = "obj_id") -> DataFrame:
    """(setting, metric, p, obj_id, lof) for numbers of neighbours and metrics (name, p; p for `minkowski` alone).

    Of each metric the largest number's neighbours serve all. The loop is over metrics; one join serves all numbers."""
    out = None
    numbers = F.array(*map(F.lit, sorted(ks)))
    for metric, p in metrics:
        near = stored(nearest(features, max(ks), key=key, metric=metric, p=p or 2), "neighbours")
        each = near.withColumn("setting", F.explode(F.filter(numbers, lambda k: k >= F.col("rank"))))
        one = lof_of(each, "setting").select("setting", F.lit(metric).alias("metric"), F.lit(p).cast("double").alias("p"), "obj_id", "lof")
        out = one if out is None else out.unionByName(one)
    return out


def nearest_to(features: DataFrame, target_id: int, n: int, clusters: DataFrame | None = None, key: str = "obj_id") -> DataFrame:
    """The n nearest to a target, over all or within its cluster."""
    table = features.join(clusters, key) if clusters is not None else features.withColumn("cluster", F.lit(0))
    target = table.filter(F.col(key) == target_id).select(F.col("features").alias("_target"), F.col("cluster").alias("_cluster")).limit(1)
    squares = F.aggregate(F.zip_with("features", "_target", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = table.join(F.broadcast(target)).filter((F.col("cluster") == F.col("_cluster")) & (F.col(key) != target_id))
    return near.select(key, squares.alias("sq_dist")).orderBy("sq_dist", key).limit(n)
