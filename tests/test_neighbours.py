"""Neighbours, LOF and DBSCAN through cells, under several metrics, against all pairs."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyweave.functions import cells as cells_module
from skyweave.functions.cells import cells_of, compared, reached, within
from skyweave.functions.metrics import metric_of
from skyweave.operators import cluster, neighbors

RNG = np.random.default_rng(3)
METRICS = [("minkowski", 2), ("cityblock", 2), ("chebyshev", 2), ("minkowski", 3), ("canberra", 2), ("cosine", 2), ("correlation", 2), ("sqeuclidean", 2), ("braycurtis", 2)]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "obj_id long, features array<double>")


def plain(x: np.ndarray, name: str, p: float) -> np.ndarray:
    """All distances by their textbook formulas."""
    a, b = x[:, None, :], x[None, :, :]
    if name == "correlation":
        a, b = a - a.mean(2, keepdims=True), b - b.mean(2, keepdims=True)
    if name in ("cosine", "correlation"):
        return 1 - (a * b).sum(2) / np.sqrt((a * a).sum(2) * (b * b).sum(2))
    d = np.abs(a - b)
    return {"minkowski": (d**p).sum(2) ** (1 / p), "cityblock": d.sum(2), "chebyshev": d.max(2), "canberra": (d / (np.abs(a) + np.abs(b))).sum(2), "sqeuclidean": (d * d).sum(2), "braycurtis": d.sum(2) / np.abs(a + b).sum(2)}[name]


@pytest.fixture
def small(monkeypatch):
    for name, n in (("CELL_ROWS", 20), ("BLOCK_ROWS", 30), ("LEAST_ROWS", 25)):
        monkeypatch.setattr(cells_module, name, n)


@pytest.mark.parametrize("name, p", METRICS)
def test_nearest_under_each_metric(spark, small, name, p):
    x = np.concatenate([c + RNG.normal(0, 0.4, (50, 3)) for c in ([1, 2, 9], [9, 1, 1], [5, 9, 4])])
    d = plain(x, name, p)
    got = neighbors.nearest(frame(spark, x), 4, metric=name, p=p).collect()
    assert len(got) == 600
    hidden = np.where(np.eye(len(x), dtype=bool), np.inf, d)
    order = np.argsort(hidden, axis=1, kind="stable")
    for r in got:
        assert r.dist == pytest.approx(d[r.obj_id, r.nb_id], abs=1e-7)
        assert r.dist == pytest.approx(hidden[r.obj_id, order[r.obj_id, r["rank"] - 1]], abs=1e-7)


def test_ties_copies_and_few_rows(spark, small):
    x = np.r_[np.zeros((70, 2)), [[3.0, 0.0], [0.0, 3.0], [-3.0, 0.0]]]
    got = {(r.obj_id, r["rank"]): (r.nb_id, r.dist) for r in neighbors.nearest(frame(spark, x), 3).collect()}
    assert [got[5, k] for k in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)] and [got[72, k] for k in (1, 2, 3)] == [(0, 3.0), (1, 3.0), (2, 3.0)]
    assert neighbors.nearest(frame(spark, x[:3]), 5).count() == 6 and neighbors.nearest(frame(spark, x).limit(0), 5).count() == 0
    assert cluster.dbscan(frame(spark, x).limit(0), 1.0, 3).count() == 0


def plain_dbscan(d: np.ndarray, eps: float, least: int) -> list:
    near = d <= eps
    core = np.flatnonzero(near.sum(1) >= least)
    label, clusters = np.full(len(d), -1), 0
    for i in core:
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = clusters
                    todo += [k for k in core if near[j, k] and label[k] < 0]
            clusters += 1
    return [label[i] if i in core else min((label[j] for j in core if near[i, j]), default=-1) for i in range(len(d))]


@pytest.mark.parametrize("name, p, eps", [("minkowski", 2, 0.5), ("cityblock", 2, 0.8), ("cosine", 2, 0.01), ("braycurtis", 2, 0.05), ("minkowski", 3, 0.5)])
def test_dbscan_under_each_metric(spark, small, name, p, eps):
    x = np.concatenate([c + RNG.normal(0, 0.5, (40, 3)) for c in ([1, 2, 9], [9, 1, 1])] + [RNG.uniform(1, 9, (30, 3))])
    got = {r.obj_id: r.cluster for r in cluster.dbscan(frame(spark, x), eps, 4, metric=name, p=p).collect()}
    want = plain_dbscan(plain(x, name, p), eps, 4)
    assert [got[i] for i in range(len(x))] == want and len(set(want)) > 2


def test_cells_rule_most_pairs_out(spark, monkeypatch):
    """On clustered data under a tenth of all pairs is looked at, for neighbours and within a radius."""
    monkeypatch.setattr(cells_module, "CELL_ROWS", 50)
    n = 3000
    centres = RNG.uniform(0, 100, (40, 4))
    x = centres[RNG.integers(0, 40, n)] + RNG.normal(0, 0.5, (n, 4))
    cells = cells_of(frame(spark, x), metric_of())
    own = cells.table.withColumn("to", F.array("cell"))
    near = neighbors.nearest(frame(spark, x), 5)
    far = near.groupBy("obj_id").agg(F.max("dist").alias("reach"))
    sent = reached(cells, cells.table.join(far, "obj_id").select(*cells.table.columns, "reach"), 5, others=True)
    assert compared(cells, own) + compared(cells, sent) < n * n / 10
    assert compared(cells, within(cells, 0.5)) < n * n / 10


def test_events_meet_spans_by_cells(spark):
    """No nested loop: spans that begin and end inside cells, at their edges, and of one sample."""
    from skyweave.operators.timeaxis import events_inside

    spans = {1: (0.0, 3.0), 2: (0.95, 1.05), 3: (-2.5, -0.1), 4: (2.0, 2.0), 5: (7.2, 7.3)}
    lc = spark.createDataFrame([(i, t) for i, ends in spans.items() for t in ends] + [(6, None)], "obj_id long, t double")
    times = [-2.5, -1.0, -0.05, 0.0, 1.0, 1.05, 1.06, 2.0, 3.0, 3.01, 7.25]
    events = spark.createDataFrame([(t,) for t in times], "event_t double")
    want = sorted((i, t) for i, (a, b) in spans.items() for t in times if a <= t <= b)
    for cell in (1.0, 0.3, 50.0):
        found = events_inside(lc, events, cell=cell)
        assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_quantiles_over_many_ranges(spark):
    """As the built-in aggregate gives them, with ties, nulls, single values and a group of most rows."""
    from skyweave.functions.quantiles import quantiles

    rows = [(0, float(RNG.integers(0, 40)) / 7) for _ in range(2000)] + [(g, None if RNG.random() < 0.1 else float(RNG.normal())) for g in range(1, 30) for _ in range(int(RNG.integers(1, 9)))] + [(None, 1.5), (None, 2.5), (99, None)]
    table, shares = spark.createDataFrame(rows, "g long, x double"), [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: list(r.quantiles) for r in quantiles(table, ["g"], "x", shares).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {r.g: list(r.q) for r in table.filter("x is not null").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in want)
    assert quantiles(table.limit(0), [], "x", [0.5]).count() == 0


def test_densest_members(spark):
    """Against the kernel summed over all members of each cluster."""
    x = np.concatenate([RNG.normal(0, 1, (40, 3)) @ np.diag([1, 2, 0.2]), RNG.normal(9, 0.5, (30, 3)), [[50.0, 50.0, 50.0]]])
    kinds = np.r_[np.zeros(40, int), np.full(30, 4), [7]]
    clusters = spark.createDataFrame([(i, int(c)) for i, c in enumerate(kinds)], "obj_id long, cluster int")
    got = {r.cluster: r.obj_id for r in cluster.densest_member(frame(spark, x), clusters).collect()}
    want = {7: 70}
    for c in (0, 4):
        own = np.flatnonzero(kinds == c)
        inverse = np.linalg.inv(np.cov(x[own].T) * len(own) ** (-2 / 7))
        d = x[own][:, None] - x[own][None]
        want[c] = own[np.exp(-0.5 * np.einsum("abi,ij,abj->ab", d, inverse, d)).sum(1).argmax()]
    assert got == want
    far = {r.obj_id: r.sq_dist for r in cluster.centre_distance(frame(spark, x), clusters, "density").collect()}
    assert far[int(want[0])] == 0 and far[3] == pytest.approx(((x[3] - x[want[0]]) ** 2).sum())
    assert cluster.densest_member(frame(spark, x).limit(0), clusters).count() == 0


def test_tiles_stay_near_the_size_of_their_distances():
    """A tile goes through all dimensions part by part: what is held beside it does not grow with it."""
    x, y = np.random.default_rng(0).normal(size=(100, 8)), np.random.default_rng(1).normal(size=(20_000, 8))
    for name in ("cityblock", "braycurtis", "canberra", "minkowski"):
        tracemalloc.start()
        got = metric_of(name, 4.0).tile(x, y)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.5 * got.nbytes, (name, peak / got.nbytes)
        assert np.array_equal(got[:, :100].diagonal(), metric_of(name, 4.0).pairs(x, y[:100]))


def test_a_row_goes_once_to_a_group_of_cells(spark, monkeypatch):
    """Where nothing is ruled out, rows meet every other once, in as many tasks as there are groups, not cells."""
    monkeypatch.setattr(cells_module, "BLOCK_ROWS", 100)
    x = np.random.default_rng(2).normal(size=(300, 40))
    own = cells_of(frame(spark, x), metric_of(), cell_rows=20)

    def met(a, b, d, exact):
        return pd.DataFrame({"obj_id": a["obj_id"].to_numpy(), "n": np.full(len(a), d.shape[1])})

    rows = cells_module.searched(own, within(own, 100.0), met, "obj_id long, n long").groupBy("obj_id").agg(F.count("*").alias("tiles"), F.sum("n").alias("n")).collect()
    assert len(own.pivots) == 15 and len(rows) == 300 and {r.n for r in rows} == {300}
    assert max(r.tiles for r in rows) <= 6


def test_a_tile_of_distances_takes_two_arrays():
    x, y = np.random.default_rng(3).normal(size=(200, 8)), np.random.default_rng(4).normal(size=(5000, 8))
    tracemalloc.start()
    d = metric_of("minkowski", 2).tile(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * d.nbytes
    assert np.allclose(d, np.sqrt(((x[:, None] - y[None]) ** 2).sum(2)))


@pytest.mark.parametrize("name", ["euclidean", "cosine", "cityblock", "chebyshev", "minkowski", "canberra", "braycurtis"])
def test_single_precision_is_off_by_its_slack_at_most(name):
    """Also of copies, of rows that hardly differ and of numbers near zero; what it cannot tell apart is in double precision."""
    way = metric_of(name, 4.0)
    x = np.r_[RNG.normal(size=(60, 64)), RNG.normal(size=(60, 64)) * RNG.uniform(0, 2, (60, 64)) ** 9]
    x = way.prepared(np.r_[x, x[:20], x[:20] + 1e-7])
    d, slack = way.quick(x, x, {})
    want = np.array([way.pairs(np.broadcast_to(r, x.shape), x) for r in x])
    assert d.dtype == np.float32 and 0 < slack < 0.1 * want.mean() and np.abs(d - want).max() <= slack
    memo = {}
    shifted = x / np.abs(x).max() + 3e5
    d, slack = way.quick(shifted, shifted, memo)
    want = np.array([way.pairs(np.broadcast_to(r, x.shape), shifted) for r in shifted])
    assert d.dtype == float and slack is None and memo["double"] and np.abs(d - want).max() <= 1e-6 * 3e5 * 8
    assert way.quick(1e-200 * x, x * 0, {})[1] is None and way.quick(x[:0], x, {})[0].shape == (0, len(x))


def test_dbscan_asks_once_for_those_alone(spark, small, monkeypatch):
    """The second search, for links, is of points that have others within the radius, among core points."""
    x = np.concatenate([RNG.normal(0, 0.1, (40, 2)), 50 * RNG.normal(size=(200, 2)) + 500 * np.arange(200)[:, None], [[0.0, 1.0]]])
    asked, searched = [], cluster.searched
    monkeypatch.setattr(cluster, "searched", lambda cells, sent, *args, **how: asked.append((sent.count(), cells.table.count())) or searched(cells, sent, *args, **how))
    got = {r.obj_id: r.cluster for r in cluster.dbscan(frame(spark, x), 0.95, 4).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= 0.95
    core = d.sum(1) >= 4
    assert asked[-1] == ((d.sum(1) > 1).sum(), core.sum()) and asked[-1][0] < 60
    assert {k for k, c in got.items() if c >= 0} == set(np.flatnonzero((d & core[None]).any(1))) and set(got.values()) == {0, -1}
