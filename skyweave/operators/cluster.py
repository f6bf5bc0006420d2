"""Clustering of feature tables and the naming of clusters."""

from collections.abc import Iterator
from dataclasses import replace
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import best_match
from ..functions.cells import Cells, cells_of, reached, searched, stacked
from ..functions.components import components
from ..functions.metrics import metric_of
from ..functions.pairs import Exact, blocked
from ..functions.quantiles import quantiles
from ..functions.sums import summed
from ..sources import numbered, stored
from .mixture import MODEL_NUMBERS, assigned, fitted, moments

UNCLASSIFIED = "UNCLASSIFIED"


def _fit(estimator, features: DataFrame, key: str) -> DataFrame:
    vectors = features.select(key, array_to_vector("features").alias("v"))
    return estimator.fit(vectors).transform(vectors).select(key, F.col("cluster").cast("int"))


def k_means(features: DataFrame, k: int, seed: int = 0, key: str = "obj_id") -> DataFrame:
    """H1."""
    return _fit(KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster"), features, key)


def lloyd(features: DataFrame, centres: list[list[float]], steps: int, key: str = "obj_id") -> DataFrame:
    """H1 from fixed centres: so many assignment and averaging steps, then a last assignment."""
    for step in range(steps + 1):
        literal = F.array(*(F.array(*map(F.lit, map(float, c))) for c in centres))
        squares = F.transform(literal, lambda c: F.aggregate(F.zip_with("features", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        assigned = features.withColumn("cluster", (F.array_position(squares, F.array_min(squares)) - 1).cast("int"))
        if step == steps:
            break
        means = assigned.select("cluster", F.posexplode("features").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))
        rows = means.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("c")).collect()  # k rows
        for r in rows:
            centres = [*centres[: r.cluster], [d.x for d in r.c], *centres[r.cluster + 1 :]]
    return assigned.select(key, "cluster")


def gaussian_mixture(features: DataFrame, k: int = 100, seed: int = 0, key: str = "obj_id") -> DataFrame:
    """H2: full covariances; the start hangs on ids and the seed, not on how the rows lie."""
    table = stored(features.select(key, "features"), "vectors")
    return assigned(table, fitted(table, k, seed, key), key)


def _near(d: np.ndarray, radius: float, exact: Exact) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs of a tile within the radius; those at its edge by their differences."""
    flat = np.flatnonzero(d <= radius + exact.slack)  # few of many: faster than in two dimensions
    i, j = np.divmod(flat, d.shape[1])
    edge = np.flatnonzero(d.ravel()[flat] >= radius - exact.slack)
    close = np.ones(len(i), bool)
    close[edge] = exact(i[edge], j[edge]) <= radius
    return i[close], j[close]


def neighbour_counts(cells: Cells, radius: float, enough: int | None = None) -> DataFrame:
    """(obj_id, n): how many points lie within a radius (of prepared rows), the point itself included. With `enough`, those
    that have so many in their own cell are not counted further."""
    key = cells.key

    def count(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray, exact: Exact, own: bool) -> pd.DataFrame:
        n = np.zeros(len(a), int)
        if d.size:
            i, j = _near(d, radius, exact)
            met = (a["cell"].to_numpy()[i] == b["cell"].to_numpy()[j]) == own  # or else in the other search
            n = np.bincount(i[met], minlength=len(a))
        return pd.DataFrame({"obj_id": a[key].to_numpy(), "n": n})

    total = lambda found: found.groupBy("obj_id").agg(F.sum("n").alias("n"))
    first = total(searched(cells, cells.table.withColumn("to", F.array("cell")), partial(count, own=True), "obj_id long, n long", apart=True))
    if len(cells.pivots) == 1:
        return first
    first = stored(first, "own-cell")
    few = cells.table if enough is None else cells.table.join(first.filter(F.col("n") < enough).select(F.col("obj_id").alias(key)).hint("merge"), key, "left_semi").select(*cells.table.columns)
    far = reached(cells, few.withColumn("reach", F.lit(float(radius))), others=True)
    return total(first.unionByName(searched(cells, far, partial(count, own=False), "obj_id long, n long")))


def core_links(flagged: Cells, radius: float) -> DataFrame:
    """(a, b, core): links of points within a radius, b being a core point: of core points a spanning forest of each
    task, of others one link to each of the forest's trees; never all pairs. The cells have the column `core`, and may have
    `alone`: points without others within the radius, which look for none."""
    key, alone = flagged.key, "alone" in flagged.table.columns
    members, asked = stored(flagged.table.filter("core").drop("alone"), "members"), flagged.table.filter("not alone").drop("alone") if alone else flagged.table
    size = np.zeros_like(flagged.size)
    for r in members.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row a pivot
        size[r.cell] = r.n
    if not size.any():
        return flagged.table.sparkSession.createDataFrame([], "a long, b long, core boolean")
    cores = replace(flagged, table=members, size=size)

    def link(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray, exact: Exact) -> pd.DataFrame:
        if not d.size:
            return pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "core": np.zeros(0, bool)})
        out: list[tuple[int, int, bool]] = []
        i, j = _near(d, radius, exact)
        near, ends = b.index.to_numpy()[j], np.searchsorted(i, np.arange(len(a) + 1))
        others = exact.memo["ids"]
        up = exact.memo.setdefault("up", np.arange(len(others)))
        ids, core, some = a[key].to_numpy(), a["core"].to_numpy(), np.flatnonzero(np.diff(ends))
        for i in some[core[some]]:
            roots = near[ends[i] : ends[i + 1]]
            while (up[roots] != roots).any():
                roots = up[roots]
            roots = np.unique(roots)
            up[roots] = roots.min()
            out += [(ids[i], r, True) for r in others[roots].tolist()]
        while (up[up] != up).any():
            up[:] = up[up]
        for i in some[~core[some]]:
            out += [(ids[i], r, False) for r in others[np.unique(up[near[ends[i] : ends[i + 1]]])].tolist()]
        return pd.DataFrame(out, columns=["a", "b", "core"]).astype({"a": "int64", "b": "int64", "core": bool})

    sent = reached(cores, asked.withColumn("reach", F.lit(float(radius))))
    return searched(cores, sent, link, "a long, b long, core boolean")


def dbscan(features: DataFrame, eps: float, min_samples: int, key: str = "obj_id", metric: str = "minkowski", p: float = 2, cell_rows: int | None = None) -> DataFrame:
    """H3: clusters numbered by their least core id; -1 is noise; a border point joins its smallest-numbered cluster."""
    way = metric_of(metric, p)
    cells, radius = cells_of(features, way, key, cell_rows=cell_rows), way.inner(eps)
    counts = neighbour_counts(cells, radius, max(min_samples, 2)).select(F.col("obj_id").alias(key), (F.col("n") >= min_samples).alias("core"), (F.col("n") == 1).alias("alone"))
    flagged = replace(cells, table=stored(cells.table.join(counts, key), "core"))
    links = stored(core_links(flagged, radius), "links")
    core = flagged.table.filter("core").select(F.col(key).alias("node"))
    parts = core.join(components(links.filter("core").select("a", "b")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    parts = stored(parts, "parts")
    ids = numbered(parts.select("component").distinct(), "component").select("component", F.col("number").cast("int").alias("cluster"))
    of_core = parts.join(ids, "component").select(F.col("node").alias("obj_id"), "cluster")
    reached = links.filter("not core").join(of_core.withColumnRenamed("obj_id", "b"), "b").groupBy(F.col("a").alias("obj_id")).agg(F.min("cluster").alias("near"))
    joined = features.select(F.col(key).alias("obj_id")).join(of_core, "obj_id", "left").join(reached, "obj_id", "left")
    return joined.select("obj_id", F.coalesce("cluster", "near", F.lit(-1)).alias("cluster"))


def densest_member(features: DataFrame, clusters: DataFrame, key: str = "obj_id") -> DataFrame:
    """H6: (cluster, obj_id, features): the member at which a Gaussian kernel over its cluster's members is densest, the
    smallest id of several. The kernel is the cluster's covariance, scaled by n ** (-2 / (d + 4)) (Scott 1992)."""
    rows = stored(features.join(clusters, key).select(F.col(key).alias("obj_id"), "features", "cluster"), "members")
    kinds = np.array(sorted(r.cluster for r in rows.select("cluster").distinct().collect()))  # a row a cluster
    k, d = len(kinds), rows.agg(F.max(F.size("features"))).first()[0] or 0
    if k * (1 + d + d * d) > MODEL_NUMBERS:
        raise ValueError(f"{k} clusters of {d} dimensions are over {MODEL_NUMBERS} numbers: project the table first")
    first = rows.select("features").limit(1).collect()
    shift = np.array(first[0].features, float) if first else np.zeros(d)

    def part(batch: pa.RecordBatch) -> np.ndarray:
        x, own, total = stacked(batch.column("features")).astype(float), np.searchsorted(kinds, batch.column("cluster").to_numpy()), 0
        for at in range(0, len(x), 1000):
            total = total + moments(np.eye(k)[own[at : at + 1000]], x[at : at + 1000] - shift)
        return total

    total = summed(rows.select("features", "cluster"), part, k * (1 + d + d * d))
    n, means = total[:k], total[k : k + k * d].reshape(k, d) / np.maximum(total[:k], 1)[:, None]
    spread = total[k + k * d :].reshape(k, d, d) / np.maximum(n, 1)[:, None, None] - means[:, :, None] * means[:, None, :]
    spread *= (n / np.maximum(n - 1, 1) * np.maximum(n, 1) ** (-2 / (d + 4)))[:, None, None]
    whiteners = np.linalg.inv(np.linalg.cholesky(spread + 1e-12 * np.eye(d)))
    shared = features.sparkSession.sparkContext.broadcast((kinds, whiteners))

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by = shared.value
        for batch in batches:
            x, own = stacked(batch.column("features")).astype(float) - shift, np.searchsorted(names, batch.column("cluster").to_numpy())
            z = [by[c] @ r for c, r in zip(own, x)]
            yield pa.record_batch([batch.column("obj_id"), pa.array(z, pa.list_(pa.float64())), batch.column("cluster")], ["obj_id", "features", "cluster"])

    def density(a: pd.DataFrame, b: pd.DataFrame, far: np.ndarray, exact: Exact) -> pd.DataFrame:
        same = a["cluster"].to_numpy()[:, None] == b["cluster"].to_numpy()[None, :]
        return pd.DataFrame({"obj_id": a["obj_id"].to_numpy(), "cluster": a["cluster"].to_numpy(), "density": (np.exp(-0.5 * far * far) * same).sum(1) if far.size else np.zeros(0)})

    white = rows.mapInArrow(whitened, "obj_id long, features array<double>, cluster int")
    sums = blocked(stored(white, "whitened"), density, "obj_id long, cluster int, density double", "obj_id", ("cluster",))
    best = sums.groupBy("obj_id", "cluster").agg(F.sum("density").alias("density")).groupBy("cluster").agg(F.min_by("obj_id", F.struct((-F.round("density", 9)).alias("density"), "obj_id")).alias("obj_id"))
    return best.join(rows.select("obj_id", "features"), "obj_id").select("cluster", "obj_id", "features")


def centres(features: DataFrame, clusters: DataFrame, method: str = "median", key: str = "obj_id") -> DataFrame:
    """H6: (cluster, dim, centre): by `median`, `mean` or `density`."""
    if method == "density":
        return densest_member(features, clusters, key).select("cluster", F.posexplode("features").alias("dim", "centre"))
    rows = features.join(clusters, key).select("cluster", F.posexplode("features").alias("dim", "x"))
    if method == "median":
        return quantiles(rows, ["cluster", "dim"], "x", [0.5]).select("cluster", "dim", F.col("quantiles")[0].alias("centre"))
    return rows.groupBy("cluster", "dim").agg(F.avg("x").alias("centre"))


def centre_distance(features: DataFrame, clusters: DataFrame, method: str = "median", key: str = "obj_id") -> DataFrame:
    """H6: (obj_id, cluster, sq_dist) to the own cluster's centre."""
    middle = centres(features, clusters, method, key).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "centre"))), lambda x: x["centre"]).alias("centre"))
    squares = F.aggregate(F.zip_with("features", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return features.join(clusters, key).join(F.broadcast(middle), "cluster").select(F.col(key).alias("obj_id"), "cluster", squares.alias("sq_dist"))


def core_members(distances: DataFrame, t_std: float) -> DataFrame:
    """H7: members within median + t_std * deviation of their cluster."""
    distances = stored(distances, "distances")
    middle = quantiles(distances, ["cluster"], "sq_dist", [0.5])
    limit = distances.groupBy("cluster").agg(F.stddev_pop("sq_dist").alias("spread")).join(middle, "cluster").select("cluster", (F.col("quantiles")[0] + t_std * F.col("spread")).alias("threshold"))
    return distances.join(F.broadcast(limit), "cluster").withColumn("is_core", (F.col("sq_dist") <= F.col("threshold")).cast("int"))


def central_member(distances: DataFrame) -> DataFrame:
    """H8."""
    return distances.groupBy("cluster").agg(F.min_by("obj_id", F.struct("sq_dist", "obj_id")).alias("obj_id"), F.min("sq_dist").alias("sq_dist"))


def name_by_match(core: DataFrame, labels: DataFrame) -> DataFrame:
    """H9: clusters get the labels of the best one-to-one match among core members; all else is UNCLASSIFIED.

    The contingency table (clusters x labels) is all that reaches the driver."""
    rows = core.filter("is_core = 1").join(labels, "obj_id").groupBy("cluster", "label").agg(F.count("*").alias("n")).collect()
    clusters, names = sorted({r.cluster for r in rows}), sorted({r.label for r in rows})
    counts = np.zeros((len(clusters), len(names)))
    for r in rows:
        counts[clusters.index(r.cluster), names.index(r.label)] = r.n
    match = best_match(counts)
    pairs = [(int(c), str(names[match[i]])) for i, c in enumerate(clusters) if i in match and counts[i, match[i]] > 0]
    table = core.sparkSession.createDataFrame(pairs, "cluster int, name string")
    name = F.when(F.col("is_core") == 1, F.col("name"))
    return core.join(F.broadcast(table), "cluster", "left").select("obj_id", "cluster", F.coalesce(name, F.lit(UNCLASSIFIED)).alias("name"))


def name_by_majority(core: DataFrame, labels: DataFrame, n_std: float) -> DataFrame:
    """The majority label of a cluster, if it leads the second by over n_std deviations of the counts.

    Every label of the cluster's members counts, with 0 where no core member has it. Members at the threshold itself
    are not core here (`sq_dist` < `threshold`)."""
    inside = F.col("is_core") == 1 if "threshold" not in core.columns else F.col("sq_dist") < F.col("threshold")
    core = core.withColumn("_in", inside.cast("int"))
    counts = core.join(labels, "obj_id").groupBy("cluster", "label").agg(F.sum("_in").alias("n"))
    w = Window.partitionBy("cluster")
    ranked = counts.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "label")), "spread": F.stddev_pop("n").over(w), "second": F.coalesce(F.lead("n").over(w.orderBy(F.desc("n"), "label")), F.lit(0))})
    won = ranked.filter((F.col("rank") == 1) & (F.col("n") > F.col("second") + n_std * F.col("spread"))).select("cluster", F.col("label").cast("string").alias("name"))
    name = F.when(F.col("_in") == 1, F.col("name"))
    return core.join(won, "cluster", "left").select("obj_id", "cluster", F.coalesce(name, F.lit(UNCLASSIFIED)).alias("name"))


def sizes(clusters: DataFrame) -> DataFrame:
    """H11."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))


def _again(d: np.ndarray, exact: Exact) -> np.ndarray:
    """Distances near zero once more, from differences."""
    out = d.copy()
    i, j = np.nonzero(d <= 2 * exact.slack)
    out[i, j] = exact(i, j)
    return out


def silhouette(features: DataFrame, clusters: DataFrame, key: str = "obj_id") -> DataFrame:
    """H4: (obj_id, silhouette), exact: sums of distances by cluster, never a row for each pair."""

    def sums(a: pd.DataFrame, b: pd.DataFrame, d: np.ndarray, exact: Exact) -> pd.DataFrame:
        d = _again(d, exact) if d.size else d
        kinds, which = np.unique(b["cluster"].to_numpy(), return_inverse=True)
        total = np.stack([d[:, which == k].sum(1) for k in range(len(kinds))], 1) if len(kinds) else np.zeros((len(a), 0))
        return pd.DataFrame({"obj_id": np.repeat(a[key].to_numpy(), len(kinds)), "cluster": np.repeat(a["cluster"].to_numpy(), len(kinds)), "other": np.tile(kinds, len(a)), "total": total.ravel()})

    joined = features.join(clusters, key)
    table = blocked(joined, sums, "obj_id long, cluster int, other int, total double", key, ("cluster",))
    n = F.broadcast(sizes(clusters).select(F.col("cluster").alias("other"), "n"))
    total = table.groupBy("obj_id", "cluster", "other").agg(F.sum("total").alias("total")).join(n, "other")
    own = F.col("cluster") == F.col("other")
    both = total.groupBy("obj_id").agg(F.max(F.when(own, F.try_divide("total", F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"), F.max(F.when(own, F.col("n"))).alias("n"))
    value = F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return both.select("obj_id", F.coalesce(value, F.lit(0.0)).alias("silhouette"))


def separation(features: DataFrame, clusters: DataFrame, key: str = "obj_id") -> DataFrame:
    """H4: one row with the Calinski-Harabasz and Davies-Bouldin scores."""
    mean = centres(features, clusters, "mean", key)
    packed = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "centre"))), lambda x: x["centre"]).alias("c"))
    d = centre_distance(features, clusters, "mean", key)
    per = d.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("sq_dist").alias("inner"), F.avg(F.sqrt("sq_dist")).alias("scatter")).join(packed, "cluster")
    all_mean = features.select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m"))
    spread = mean.join(all_mean, "dim").groupBy("cluster").agg(F.sum((F.col("centre") - F.col("m")) * (F.col("centre") - F.col("m"))).alias("outer"))
    table = stored(per.join(spread, "cluster"), "clusters")
    ch = table.agg(F.sum(F.col("n") * F.col("outer")).alias("b"), F.sum("inner").alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    ch = ch.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))
    other = table.select(F.col("cluster").alias("oc"), F.col("scatter").alias("os"), F.col("c").alias("o"))
    apart = F.sqrt(F.aggregate(F.zip_with("c", "o", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    db = table.join(F.broadcast(other), F.col("cluster") != F.col("oc")).groupBy("cluster").agg(F.max((F.col("scatter") + F.col("os")) / apart).alias("worst"))
    return ch.join(F.broadcast(db.agg(F.avg("worst").alias("davies_bouldin"))))


def mixture_scan(features: DataFrame, components: list[int], seed: int = 0, key: str = "obj_id") -> DataFrame:
    """H5: one row a setting: clusters used, mean silhouette, and both separation scores. The loop is over settings."""
    out = None
    for k in components:
        clusters = stored(gaussian_mixture(features, k, seed, key), "mixture")
        row = silhouette(features, clusters, key).agg(F.avg("silhouette").alias("silhouette")).join(F.broadcast(separation(features, clusters, key)))
        row = row.join(F.broadcast(clusters.agg(F.count_distinct("cluster").alias("clusters")))).withColumn("setting", F.lit(k))
        out = row if out is None else out.unionByName(row)
    return out


def two_pass(features: DataFrame, parts: DataFrame, labels: DataFrame, k: int, t_std: float, key: str = "obj_id") -> DataFrame:
    """Objects of low and of high error are clustered and named apart, then put together."""
    out = None
    for part in ("low", "high"):
        own = features.join(parts.filter(F.col("part") == part).select(key), key, "left_semi")
        clusters = stored(gaussian_mixture(own, k, 0, key), "pass")
        named = name_by_match(core_members(centre_distance(own, clusters, "median", key), t_std), labels).withColumn("part", F.lit(part))
        out = named if out is None else out.unionByName(named)
    return out
