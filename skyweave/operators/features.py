"""Features of series and work on feature tables (obj_id, features array<double>)."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periodogram import floating_mean, spectral_features
from ..functions.transits import dip, least_grid, longest_transit, transit_search
from .normalize import by_median

SPECTRAL = ("peak_power", "ln_peak_power", "peak_period", "area_long", "area_middle", "area_short", "fast_period")
MOMENTS = ("mean", "m2", "m3", "m4", "ln_m2", "ln_m3", "ln_m4")


def moments(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """Mean, central moments 2 to 4 (not standardised) and logarithms of their sizes."""
    around = lc.withColumn("d", F.col("flux") - F.avg("flux").over(Window.partitionBy(key)))
    out = around.groupBy(key).agg(F.avg("flux").alias("mean"), *(F.avg(F.pow("d", F.lit(k))).alias(f"m{k}") for k in (2, 3, 4)))
    return out.select("*", *(F.ln(F.abs(f"m{k}")).alias(f"ln_m{k}") for k in (2, 3, 4)))


def trend(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """E3."""
    return lc.groupBy(key).agg(F.regr_slope("flux", "t").alias("slope")).withColumn("ln_slope", F.ln(F.abs("slope")))


def spectra(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """E2, E4, E5 in one pass a series; NULL where a spectrum has no peak."""

    def run(k: tuple, series: pd.DataFrame) -> pd.DataFrame:
        series = series.dropna(subset=["flux"]).sort_values("t")
        return pd.DataFrame([(k[0], *spectral_features(series["t"].to_numpy(float), series["flux"].to_numpy(float)))], columns=[key, *SPECTRAL])

    got = lc.select(key, "t", "flux").groupBy(key).applyInPandas(run, f"{key} long, " + ", ".join(f"{c} double" for c in SPECTRAL))
    return got.select(key, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in SPECTRAL))


def _sixteen(t: np.ndarray, flux: np.ndarray) -> tuple[float, ...]:
    middle = np.median(flux) if len(flux) else 0.0
    if not middle:
        return (np.nan,) * 16
    y = flux / middle
    m = [np.mean((y - y.mean()) ** k) for k in (2, 3, 4)]
    spread = t - t.mean()
    slope = (spread @ y) / (spread @ spread) if (spread @ spread) > 0 else np.nan
    peak, ln_peak, period, *rest = spectral_features(t, y)
    with np.errstate(divide="ignore"):
        return (y.mean(), *m, *np.log(np.abs(m)), peak, ln_peak, period, slope, np.log(np.abs(slope)), *rest)


def engineered(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """The 16 features of every object after division by the median, in one pass: moments, peak, slope, areas, fast
    peak. NULL where E1 to E5 give none (a median of 0 gives none at all)."""
    names = [*MOMENTS, *SPECTRAL[:3], "slope", "ln_slope", *SPECTRAL[3:]]

    def run(k: tuple, series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("t")
        return pd.DataFrame([(k[0], *_sixteen(series["t"].to_numpy(float), series["flux"].to_numpy(float)))], columns=[key, *names])

    got = lc.filter("flux is not null").select(key, "t", "flux").groupBy(key).applyInPandas(run, f"{key} long, " + ", ".join(f"{c} double" for c in names))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    return got.select(key, *map(finite, names))


def transit_features(lc: DataFrame, stars: DataFrame | None = None, key: str = "obj_id", transits: int = 2, finer: float = 3.0, bins: int = 512) -> DataFrame:
    """(key, period, duration, depth, power): the best limb-darkened dip over a grid of periods that follows each
    object's span in time and its star; power: deviations above the mean of all periods. NULL where none is found.

    stars: (key, radius, mass) in units of the Sun, NULL or absent where unknown; of these the star that needs the fewest
    periods is taken. An object's samples and its star meet in one pass."""
    schema = f"{key} long, period double, duration double, depth double, power double"
    names = [key, "period", "duration", "depth", "power"]

    def one(k: tuple, series: pd.DataFrame, star: pd.DataFrame) -> pd.DataFrame:
        if not len(series):
            return pd.DataFrame({c: [] for c in names})
        series = series.dropna(subset=["t", "flux"]).sort_values("t")
        t, flux, row = series["t"].to_numpy(float), series["flux"].to_numpy(float), (np.nan,) * 4
        if len(t) > 2:
            known = [float(star[c].min()) if len(star) else np.nan for c in ("radius", "mass")]
            periods, radius, mass = least_grid(t[-1] - t[0], *known, transits=transits, finer=finer)
            row = transit_search(t, flux, periods, longest_transit(periods, radius, mass), bins)
        return pd.DataFrame([(k[0], *row)], columns=names)

    samples = lc.select(key, "t", "flux").groupBy(key)
    if stars is None:
        got = samples.applyInPandas(lambda k, series: one(k, series, pd.DataFrame()), schema)
    else:
        got = samples.cogroup(stars.select(key, "radius", "mass").groupBy(key)).applyInPandas(one, schema)
    return got.select(key, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in names[1:]))


def fold_powers(lc: DataFrame, period: float, width: int, bins: int = 512, key: str = "obj_id") -> DataFrame:
    """One period and one width of the search: (key, bin, power, depth) of a dip from each bin on, where one takes light."""
    at = F.least(F.floor(F.pmod(F.col("t") / period, F.lit(1.0)) * bins), F.lit(bins - 1))
    cells = lc.filter("flux is not null and t is not null").groupBy(key, at.alias("cell")).agg(F.count("*").alias("n"), F.sum("flux").alias("s"))
    level = Window.partitionBy(key)
    cells = cells.withColumns({"total": F.sum("n").over(level), "mean": F.sum("s").over(level) / F.sum("n").over(level)})
    shape = F.array(*(F.lit(float(q)) for q in dip(width)))
    spread = cells.select(key, "total", "n", (F.col("n") * F.col("mean") - F.col("s")).alias("lack"), "cell", F.posexplode(shape).alias("j", "q"))
    starts = spread.groupBy(key, F.pmod(F.col("cell") - F.col("j"), F.lit(bins)).cast("int").alias("bin"))
    sums = starts.agg(F.sum(F.col("q") * F.col("lack")).alias("missing"), F.sum(F.col("q") * F.col("n")).alias("first"), F.sum(F.col("q") * F.col("q") * F.col("n")).alias("second"), F.max("total").alias("total"))
    sums = sums.withColumn("spread", F.col("second") - F.col("first") * F.col("first") / F.col("total")).filter("spread > 1e-6 and missing > 0")
    return sums.select(key, "bin", (F.col("missing") * F.col("missing") / F.col("spread")).alias("power"), (F.col("missing") / F.col("spread")).alias("depth"))


def power_spectra(lc: DataFrame, freq: list[float], key: str = "obj_id") -> DataFrame:
    """(key, freq, power) on a common grid of frequencies per day."""
    grid = np.array(freq)

    def run(k: tuple, series: pd.DataFrame) -> pd.DataFrame:
        series = series.dropna(subset=["flux"]).sort_values("t")
        power = floating_mean(series["t"].to_numpy(float), series["flux"].to_numpy(float), 2 * np.pi * grid) if len(series) > 2 else np.full(len(grid), np.nan)
        return pd.DataFrame({key: [k[0]], "freq": [grid], "power": [power]})

    return lc.select(key, "t", "flux").groupBy(key).applyInPandas(run, f"{key} long, freq array<double>, power array<double>")


def variability(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """P95 - P5 of the median-normalised flux."""
    q = F.percentile("flux", F.array(F.lit(0.05), F.lit(0.95)))
    return by_median(lc, key).groupBy(key).agg(q.alias("q")).select(key, (F.col("q")[1] - F.col("q")[0]).alias("variability"))


def join_families(tables: list[DataFrame], key: str = "obj_id", log: bool = False) -> DataFrame:
    """One row an object with all families' columns, rows with NULL or NaN dropped, logarithms of sizes if asked."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key)
    columns = [c for c in out.columns if c != key]
    out = out.dropna(subset=columns)
    return out.select(key, *(F.ln(F.abs(c)).alias(c) if log else F.col(c) for c in columns))


def long_form(features: DataFrame, key: str = "obj_id") -> DataFrame:
    return features.select(key, F.posexplode("features").alias("dim", "x"))


def outlier_hits(features: DataFrame, sigma: float, key: str = "obj_id") -> DataFrame:
    """(object, feature) with a value beyond mean +- sigma deviations, or missing."""
    rows = long_form(features, key)
    stats = rows.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    beyond = F.col("x").isNull() | F.isnan("x") | (F.abs(F.col("x") - F.col("m")) > sigma * F.col("s"))
    return rows.join(F.broadcast(stats), "dim").filter(beyond).select(key, "dim", "x")


def without_outliers(features: DataFrame, sigma: float, key: str = "obj_id") -> DataFrame:
    """Objects without any hit."""
    return features.join(outlier_hits(features, sigma, key).select(key).distinct(), key, "left_anti")


def correlations(features: DataFrame) -> DataFrame:
    """(i, j, corr) for all pairs i <= j of columns: products of centred blocks, summed; NULL for a constant one."""
    middle = long_form(features.filter("features is not null"), "obj_id").groupBy("dim").agg(F.avg("x").alias("m"))
    means = np.array([r.m for r in middle.orderBy("dim").collect()], float)  # a number a column

    def products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(means), len(means)))
        for part in parts:
            if len(part):
                x = np.stack(part["features"].to_numpy()) - means
                total += x.T @ x
        i, j = np.triu_indices(len(means))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "s": total[i, j]})

    cells = features.filter("features is not null").select("features").mapInPandas(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    own = cells.filter("i = j")
    both = cells.join(F.broadcast(own.select("i", F.col("s").alias("si"))), "i").join(F.broadcast(own.select("j", F.col("s").alias("sj"))), "j")  # a row a column
    return both.select("i", "j", F.try_divide("s", F.sqrt(F.col("si") * F.col("sj"))).alias("corr"))


def extremes(features: DataFrame, dims: tuple[int, int], n: int = 3, key: str = "obj_id") -> DataFrame:
    """Objects among the n lowest or highest of either feature, each once."""
    parts = []
    for d in dims:
        x = F.col("features")[d]
        parts += [features.orderBy(x, key).limit(n).select(key), features.orderBy(x.desc(), key).limit(n).select(key)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def histogram(table: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts of equal bins between the least and the largest value (which belongs to the last bin)."""
    ends = table.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    at = F.least(F.floor((F.col(column) - F.col("_a")) / ((F.col("_b") - F.col("_a")) / bins)), F.lit(bins - 1))
    return table.filter(F.col(column).isNotNull()).join(F.broadcast(ends)).groupBy(*(by or []), at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(features: DataFrame, dims: tuple[int, int], bins: int) -> DataFrame:
    """E14 in two dimensions."""
    xy = features.select(F.col("features")[dims[0]].alias("x"), F.col("features")[dims[1]].alias("y"))
    ends = xy.agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("a", F.min), ("b", F.max))))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}a")) / ((F.col(f"{c}b") - F.col(f"{c}a")) / bins)), F.lit(bins - 1)).cast("int")
    return xy.join(F.broadcast(ends)).groupBy(at("x").alias("bin_x"), at("y").alias("bin_y")).agg(F.count("*").alias("n"))


def strongest(features: DataFrame, n: int = 2, key: str = "obj_id") -> DataFrame:
    """The n features of largest size of each object."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("x").desc(), "dim"))
    return long_form(features, key).withColumn("rank", rank).filter(F.col("rank") <= n)
