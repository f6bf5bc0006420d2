"""Gaussian mixtures with full covariances, by sums over the table, from a start that hangs on ids and a seed alone.

The start is found as in k-means||: in each round a row becomes a candidate with a chance in proportion to its squared
distance from those so far, the draw being a hash of its id; the candidates, weighted by the rows nearest to them, are
thinned out to k in the driver. A pass of expectation and maximisation sums weights, means and products of each
component, k * d * d numbers, in tasks; the driver holds these. How a table is split changes no more than last digits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import stacked
from ..functions.sums import summed

#: Rounds of the start, candidates a round for each component (so many as expected), steps of k-means after it.
ROUNDS, OVER, STEPS = 4, 2, 3
#: What each variance gains, so that none vanishes; numbers of a model that the driver and all tasks hold at most.
LEAST_VARIANCE, MODEL_NUMBERS = 1e-6, 8_000_000
#: Rows at once.
BATCH = 1_000


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = np.einsum("ik,ik->i", x, x)[:, None] + np.einsum("jk,jk->j", centres, centres)[None, :] - 2 * x @ centres.T
    return np.maximum(d, 0)


def start_centres(features: DataFrame, k: int, seed: int = 0, key: str = "obj_id") -> np.ndarray:
    """k centres; fewer if there are fewer different rows."""
    spark = features.sparkSession
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(0), key), F.lit(1 << 53)).cast("double") / (1 << 53)
    first = features.orderBy(F.xxhash64(F.lit(seed), key), key).select("features").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    centres = np.array([first[0].features], float)
    for step in range(1, ROUNDS + 1):
        shared = spark.sparkContext.broadcast(centres)

        def cost(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            return np.array([_squares(stacked(batch.column("features")).astype(float), shared.value).min(1).sum()])

        total = summed(features.select("features"), cost, 1)[0]
        if total <= 0:
            break
        wanted = OVER * k / total

        def drawn(batches: Iterator[pa.RecordBatch], shared=shared, wanted=wanted) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _squares(stacked(batch.column("features")).astype(float), shared.value).min(1) if batch.num_rows else np.zeros(0)
                yield batch.filter(pa.array(batch.column("draw").to_numpy() < wanted * far)).select([key, "features"])

        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(step), key), F.lit(1 << 53)).cast("double") / (1 << 53)
        rows = features.select(F.col(key).cast("long").alias(key), F.col("features").cast("array<double>").alias("features"), draw.alias("draw"))
        picked = rows.mapInArrow(drawn, f"{key} long, features array<double>").collect()  # OVER * k expected
        centres = np.r_[centres, np.array([r.features for r in sorted(picked, key=lambda r: r[key])], float).reshape(len(picked), -1)] if picked else centres
    centres = np.unique(centres, axis=0)
    shared = spark.sparkContext.broadcast(centres)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        return np.bincount(_squares(stacked(batch.column("features")).astype(float), shared.value).argmin(1), minlength=len(shared.value)).astype(float)

    weights, rng = summed(features.select("features"), count, len(centres)), np.random.default_rng(seed)
    picks = [int(np.argmax(weights))]
    while len(picks) < min(k, len(centres)):
        chance = weights * _squares(centres, centres[picks]).min(1)
        if chance.sum() <= 0:
            break
        picks.append(int(rng.choice(len(centres), p=chance / chance.sum())))
    return centres[picks]


class Mixture:
    """weights (k), means (k, d) and covariances (k, d, d)."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray):
        self.weights, self.means, self.covariances = weights, means, covariances
        lower = np.linalg.cholesky(covariances + 0.0)
        self.whitener = np.linalg.inv(lower)
        self.offset = np.log(np.maximum(weights, 1e-300)) - np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1) - means.shape[1] / 2 * np.log(2 * np.pi)

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each component, for each row."""
        return np.stack([o - 0.5 * (((x - m) @ w.T) ** 2).sum(1) for o, m, w in zip(self.offset, self.means, self.whitener)], 1)


def from_sums(total: np.ndarray, k: int, d: int, centre: np.ndarray, least: float = LEAST_VARIANCE) -> Mixture:
    """A mixture from sums of shares, of shares times rows, and times products of rows; rows less a centre."""
    n = total[:k]
    first, second = total[k : k + k * d].reshape(k, d), total[k + k * d : k + k * d + k * d * d].reshape(k, d, d)
    some = np.maximum(n, 1e-10)
    means = first / some[:, None]
    spread = second / some[:, None, None] - means[:, :, None] * means[:, None, :]
    return Mixture(n / n.sum(), means + centre, spread + least * np.eye(d))


def moments(shares: np.ndarray, x: np.ndarray) -> np.ndarray:
    products = np.einsum("nk,ni,nj->kij", shares, x, x, optimize=True)
    return np.r_[shares.sum(0), (shares.T @ x).ravel(), products.ravel()]


def step(features: DataFrame, model: Mixture, centre: np.ndarray, least: float = LEAST_VARIANCE) -> tuple[Mixture, float]:
    """One pass of expectation and maximisation: the next mixture, and the mean log-likelihood under this one."""
    (k, d), shared = model.means.shape, features.sparkSession.sparkContext.broadcast((model, centre))
    size = k + k * d + k * d * d

    def part(batch: pa.RecordBatch) -> np.ndarray:
        own, middle = shared.value
        every, total = stacked(batch.column("features")).astype(float), np.zeros(size + 1)
        for at in range(0, len(every), BATCH):
            x = every[at : at + BATCH]
            logs = own.logs(x)
            top = logs.max(1, keepdims=True)
            shares = np.exp(logs - top)
            whole = shares.sum(1, keepdims=True)
            total += np.r_[moments(shares / whole, x - middle), (top + np.log(whole)).sum()]
        return total

    total = summed(features.select("features"), part, size + 1)
    return from_sums(total, k, d, centre, least), float(total[-1] / max(total[:k].sum(), 1e-300))


def started(features: DataFrame, k: int, seed: int = 0, key: str = "obj_id") -> tuple[Mixture | None, np.ndarray]:
    """A mixture of the clusters that some steps of k-means from the start centres give, and a centre of the rows."""
    centres = start_centres(features, k, seed, key)
    if not len(centres):
        return None, np.zeros(0)
    k, d = centres.shape
    if k * (1 + d + d * d) > MODEL_NUMBERS:
        raise ValueError(f"{k} components of {d} dimensions are over {MODEL_NUMBERS} numbers: project the table first")
    middle = centres.mean(0)
    for at in range(STEPS + 1):
        shared = features.sparkSession.sparkContext.broadcast(centres)

        def part(batch: pa.RecordBatch, shared=shared) -> np.ndarray:
            every, total = stacked(batch.column("features")).astype(float), 0
            for at in range(0, len(every), BATCH):
                x = every[at : at + BATCH]
                shares = np.eye(k)[_squares(x, shared.value).argmin(1)]
                total = total + moments(shares, x - middle)
            return total

        total = summed(features.select("features"), part, k + k * d + k * d * d)
        some = total[:k] > 0
        if at < STEPS:
            centres = np.where(some[:, None], total[k : k + k * d].reshape(k, d) / np.maximum(total[:k], 1)[:, None] + middle, centres)
    model = from_sums(total, k, d, middle)
    model.means[~some] = centres[~some]
    return Mixture(model.weights, model.means, model.covariances), middle


def fitted(features: DataFrame, k: int, seed: int = 0, key: str = "obj_id", rounds: int = 100, tol: float = 1e-3) -> Mixture | None:
    """H2: passes until the mean log-likelihood gains less than tol."""
    model, middle = started(features, k, seed, key)
    if model is None:
        return None
    before = -np.inf
    for _ in range(rounds):
        after, now = step(features, model, middle)
        if now - before < tol:
            break
        model, before = after, now
    return model


def assigned(features: DataFrame, model: Mixture | None, key: str = "obj_id") -> DataFrame:
    """(key, cluster): the likeliest component of each row."""
    rows = features.select(F.col(key).cast("long").alias(key), "features")
    if model is None:
        return rows.select(key, F.lit(0).alias("cluster"))
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stacked(batch.column("features")).astype(float)
            best = [shared.value.logs(x[at : at + BATCH]).argmax(1) for at in range(0, len(x), BATCH)]
            yield pa.record_batch([batch.column(key), pa.array(np.concatenate(best).astype(np.int32) if best else np.zeros(0, np.int32))], [key, "cluster"])

    return rows.mapInArrow(run, f"{key} long, cluster int")
