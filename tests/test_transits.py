"""Transits, fast spectra and bucketed tables: against plain sums, planted signals and plans."""

import time

import numpy as np
import pytest

from skyweave.functions import periodogram, transits
from skyweave.operators import clean, features, normalize, timeaxis
from skyweave.sources import read_sector, series_buckets, write_series

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("n", [3, 50, 2000])
@pytest.mark.parametrize("start", [0.0, 2458000.0])
def test_transform_gives_the_sums(n, start):
    t, y = start + np.sort(RNG.uniform(0, 27, n)), RNG.normal(1, 0.1, n)
    for m in (65, 300, 501):
        omega = np.linspace(0.6, 62.8, m)
        waves = np.exp(1j * np.outer(omega, t))
        got = periodogram.wave_sums(t, omega, y, np.ones(n))
        for x, want in zip(got, (waves @ y, waves.sum(1), (waves * waves).sum(1))):
            # at a time of 2458000 days a phase itself has 8 digits left
            assert np.abs(x - want).max() < n * (1e-10 if start == 0 else 1e-6)


def test_spectra_grow_with_the_samples():
    """Forty times the samples take at most as many times as long, and far less than the sums themselves."""
    took = []
    for n in (500, 20_000):
        t, y = np.sort(RNG.uniform(0, 27, n)), RNG.normal(size=n)
        periodogram.classic(t, y, periodogram.OMEGA)
        began = time.perf_counter()
        periodogram.classic(t, y, periodogram.OMEGA)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * took[0] and took[1] < 0.5


def test_period_grid():
    grid = transits.period_grid(27.0)
    assert grid[0] == pytest.approx(13.5) and (np.diff(grid) < 0).all() and 0.55 < grid[-1] < 0.65
    assert len(transits.period_grid(27.0, finer=6)) == pytest.approx(2 * len(grid), abs=2)
    # neighbouring periods drift apart by less than a third of the longest transit over the span
    drift = 27.0 / grid[1:] * -np.diff(grid)
    assert (drift < transits.longest_transit(grid[1:]) / 2).all()
    assert len(transits.period_grid(0.5)) == len(transits.period_grid(0.0)) == 0
    assert transits.longest_transit(np.array([365.25]))[0] * 24 == pytest.approx(13, abs=0.1)
    shorter = transits.least_grid(27.0, 2.0, float("nan"))
    assert shorter[1:] == (2.0, 1.0) and len(shorter[0]) < len(grid)
    assert transits.least_grid(27.0, float("nan"), 0.0)[1:] == (1.0, 1.0)


def test_dip_powers_are_least_squares():
    bins, width = 40, 5
    at, y = RNG.integers(0, bins, 70), RNG.normal(size=70)
    counts, lack = np.bincount(at, minlength=bins).astype(float), np.bincount(at, y.mean() - y, bins)
    power, depth = transits.dip_powers(np.fft.rfft(counts[None]), np.fft.rfft(lack[None]), 70, width, bins)
    shape = transits.dip(width)
    assert shape.max() < 1.001 and shape[2] > 0.98 and np.allclose(shape, shape[::-1])
    for start in range(bins):
        q = np.zeros(bins)
        q[(start + np.arange(width)) % bins] = shape
        design = np.column_stack([np.ones(70), -q[at]])
        fit = np.linalg.lstsq(design, y, rcond=None)[0]
        saved = ((y - y.mean()) ** 2).sum() - ((y - design @ fit) ** 2).sum()
        assert (power[0, start], depth[0, start]) == ((pytest.approx(saved), pytest.approx(fit[1])) if fit[1] > 0 else (0, 0))


def planted(period: float, depth: float, n: int = 3000, noise: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    t = np.sort(RNG.uniform(0, 27, n))
    length = transits.longest_transit(np.array([period]))[0]
    z = 2 * ((t - 0.4 + length / 2) % period) / length - 1
    edge = 1 - np.sqrt(np.maximum(1 - z * z, 0))
    return t, 1 - depth * np.where(np.abs(z) < 1, 1 - 0.48 * edge - 0.19 * edge**2, 0) + RNG.normal(0, noise, n)


def test_planted_transits_are_found(spark):
    table, want = [], {1: (2.7, 0.01), 2: (6.3, 0.02), 3: (0.9, 0.005)}
    for key, (period, depth) in want.items():
        table += [(key, float(a), float(b)) for a, b in zip(*planted(period, depth))]
    table += [(4, float(a), float(b)) for a, b in zip(*planted(5.0, 0.0))]  # noise alone
    table += [(5, 0.0, 1.0), (5, 1.0, None), (6, None, 1.0), (7, 1.0, 2.0), (7, 1.0, 2.0), (7, 1.0, 2.0), *((8, float(i), 1.0) for i in range(30))]
    lc = spark.createDataFrame(table, "obj_id long, t double, flux double")
    stars = spark.createDataFrame([(1, 1.0, 1.0), (2, None, None), (3, 1.2, None), (99, 1.0, 1.0)], "obj_id long, radius double, mass double")
    got = {r.obj_id: r for r in features.transit_features(lc, stars).collect()}
    assert set(got) == set(range(1, 9))
    for key, (period, depth) in want.items():
        r = got[key]
        assert r.period == pytest.approx(period, rel=0.01) and r.depth == pytest.approx(depth, rel=0.25) and r.power > 8
        assert r.duration == pytest.approx(transits.longest_transit(np.array([period]))[0], rel=0.4)
    assert got[4].power < 8 and all(got[k].period is None and got[k].power is None for k in (5, 6, 7, 8))
    alone = {r.obj_id: r for r in features.transit_features(lc).collect()}
    assert alone[2] == got[2] and alone[1] == got[1]


def test_search_and_fold_agree(spark):
    t, y = planted(2.7, 0.01, 400)
    lc = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, y)], "obj_id long, t double, flux double")
    rows = features.fold_powers(lc, 2.7, 9, 128).collect()
    at = np.minimum((t / 2.7 % 1.0 * 128).astype(int), 127)
    power, depth = transits.dip_powers(np.fft.rfft(np.bincount(at, minlength=128)[None]), np.fft.rfft(np.bincount(at, y.mean() - y, 128)[None]), 400, 9, 128)
    assert {r.bin for r in rows} == set(np.flatnonzero(power[0]))
    assert all((r.power, r.depth) == (pytest.approx(power[0, r.bin], abs=1e-9), pytest.approx(depth[0, r.bin], abs=1e-9)) for r in rows)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_series_need_no_exchange(spark, tmp_path):
    rows = [(o, s, 10.0 * s + i, float(RNG.normal(5)), int(i == 3)) for o in range(40) for s in (1, 2) for i in range(20) if o % 5 or s == 1]
    lc = spark.createDataFrame(rows, "obj_id long, sector int, t double, flux double, quality int")

    def chain(series):
        good = clean.drop_missing(clean.mask_flagged(series))
        return features.engineered(timeaxis.stitch(normalize.by_median(good), ["quality"]))

    table = write_series(lc, "bucketed_series", str(tmp_path / "series"), buckets=4)
    assert "hashpartitioning(obj_id" in plan(chain(lc)) and "hashpartitioning(obj_id" not in plan(chain(table))
    as_rows = lambda df: sorted((tuple(None if x is None else round(x, 9) for x in r) for r in df.collect()), key=str)
    assert as_rows(chain(table)) == as_rows(chain(lc)) and chain(table).count() == 32
    assert sorted(map(tuple, table.select(lc.columns).collect())) == sorted(rows)
    files = sorted(str(f.relative_to(tmp_path / "series").parent) for f in (tmp_path / "series").rglob("*.parquet"))
    assert set(files) == {"sector=1", "sector=2"} and len(files) <= 2 * 4
    only = plan(read_sector(table, 2).select("flux"))
    assert "PartitionFilters" in only and "Exchange" not in only
    assert series_buckets(lc) == spark.sparkContext.defaultParallelism


def test_buckets_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr("skyweave.sources.BUCKET_BYTES", 320)
    assert series_buckets(spark.range(1001)) == 101


@pytest.mark.parametrize("bins", [40, 100, 509, 512])
def test_bounded_dips_are_the_best_of_all(bins):
    for n in (3, 20, 60):
        cells, lack = RNG.integers(0, bins, (30, n)), RNG.exponential(size=n)
        lack = lack.mean() - lack
        widths = np.array(transits.widths_of(bins))[1:8]
        use = RNG.random((30, len(widths))) < 0.7
        use[:, 0] = True
        got, want = (f(cells, lack, bins, widths, use) for f in (transits.best_dips, transits.every_dip))
        assert np.allclose(got[0], want[0], rtol=1e-10, atol=1e-12) and got[1][0] == pytest.approx(want[1][0])


def test_sparse_series_are_searched_faster_than_by_all_starts(monkeypatch):
    """67 samples fill an eighth of the bins: most starts are ruled out by their bound."""
    t, y = np.sort(RNG.uniform(0, 30, 67)), RNG.exponential(50, 67)
    periods = transits.period_grid(t[-1] - t[0])
    longest, took, found = transits.longest_transit(periods), [], []
    for search in (transits.best_dips, transits.every_dip):
        monkeypatch.setattr(transits, "best_dips", search)
        times = []
        for _ in range(3):
            began = time.perf_counter()
            found.append(transits.transit_search(t, y, periods, longest))
            times.append(time.perf_counter() - began)
        took.append(min(times))
    assert found[0] == pytest.approx(found[-1]) and took[0] < 0.7 * took[1]
