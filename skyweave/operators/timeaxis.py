"""Gaps, time axes, stitching and binning."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import fill_gaps, high_passed_rms
from .normalize import standardize

#: What sums of doubles may be off by, as a part of their values.
ROUNDING = 1e-12


def _ordered(key: str = "obj_id", by: str = "i"):
    return Window.partitionBy(key).orderBy(by)


def missing_runs(grid: DataFrame, key: str = "obj_id", i: str = "i") -> DataFrame:
    """(key, start, length) of each run of missing samples."""
    holes = grid.filter(F.col("flux").isNull()).withColumn("island", F.col(i) - F.row_number().over(_ordered(key, i)))
    return holes.groupBy(key, "island").agg(F.min(i).alias("start"), F.count("*").alias("length")).drop("island")


def cadence(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """The least positive time difference."""
    step = F.col("t") - F.lag("t").over(_ordered(key, "t"))
    return lc.withColumn("step", step).filter("step > 0").groupBy(key).agg(F.min("step").alias("cadence"))


def classify_runs(grid: DataFrame, key: str = "obj_id", i: str = "i") -> DataFrame:
    """D3: runs with kind leading, trailing, orbit (the longest of the rest, first on ties) or gap."""
    ends = grid.groupBy(key).agg(F.min(i).alias("first"), F.max(i).alias("last"))
    runs = missing_runs(grid, key, i).join(ends, key)
    edge = F.when(F.col("start") == F.col("first"), "leading").when(F.col("start") + F.col("length") - 1 == F.col("last"), "trailing")
    runs = runs.withColumn("edge", edge)
    rank = F.row_number().over(Window.partitionBy(key, F.col("edge").isNull()).orderBy(F.desc("length"), "start"))
    kind = F.coalesce("edge", F.when(F.col("rank") == 1, "orbit").otherwise("gap"))
    return runs.withColumn("rank", rank).select(key, "start", "length", kind.alias("kind"))


def fill_linear(grid: DataFrame, most: int, key: str = "obj_id", i: str = "i") -> DataFrame:
    """D4, linear part: inner runs shorter than `most` samples get values on the line between their neighbours."""
    w = _ordered(key, i)
    known = F.when(F.col("flux").isNotNull(), F.struct(F.col(i).alias("i"), F.col("flux").alias("flux")))
    g = grid.withColumn("before", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = g.withColumn("after", F.first(known, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    line = F.col("before.flux") + (F.col("after.flux") - F.col("before.flux")) * (F.col(i) - F.col("before.i")) / (F.col("after.i") - F.col("before.i"))
    short = F.col("after.i") - F.col("before.i") - 1 < most
    return g.withColumn("flux", F.coalesce("flux", F.when(short, line))).drop("before", "after")


def interpolate(lc: DataFrame, tol_days: float = 20 / 1440, sigma: float = 10.0, search: int = 200, key: str = "obj_id") -> DataFrame:
    """D4 in full (with B3 first): one pass a series; spline on longer gaps where local statistics allow it."""

    def fill(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("t")
        return series.assign(flux=fill_gaps(series["t"].to_numpy(float), series["flux"].to_numpy(float), tol_days, sigma, search))

    got = lc.groupBy(key).applyInPandas(fill, lc.schema)
    return got.withColumn("flux", F.when(~F.isnan("flux"), F.col("flux")))


def fill_times(times: DataFrame, i: str = "i") -> DataFrame:
    """Missing times of the common axis by index interpolation; edges stay. The axis has one row an index."""
    axis = times.withColumn("all", F.lit(0)).withColumnRenamed("t", "flux")
    return fill_linear(axis, 1 << 40, "all", i).drop("all").withColumnRenamed("flux", "t")


def split_at_largest_gap(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """Part 0 up to the largest gap in time (first on ties), part 1 after it."""
    gap = F.lead("t").over(_ordered(key, "t")) - F.col("t")
    ends = lc.withColumn("gap", gap).groupBy(key).agg(F.max_by("t", F.struct("gap", -F.col("t"))).alias("gap_start"))
    return lc.join(ends, key).withColumn("part", F.when(F.col("t") <= F.col("gap_start"), 0).otherwise(1))


def stitch(lc: DataFrame, meta: list[str], key: str = "obj_id") -> DataFrame:
    """Series of objects that are in all sectors, each sector scaled to [0, 1]; metadata joined by commas."""
    w = Window.partitionBy(key, "sector")
    a, b = F.min("flux").over(w), F.max("flux").over(w)
    scaled = lc.withColumn("flux", F.try_divide(F.col("flux") - a, b - a))
    return scaled.join(_in_all_sectors(lc, meta, key).drop("n"), key)


def _in_all_sectors(lc: DataFrame, meta: list[str], key: str) -> DataFrame:
    """Objects that are in all sectors, how many these are, and their metadata, joined by commas in order of sector."""
    sectors = lc.select("sector").distinct().agg(F.count("*").alias("sectors"))  # one row
    per = lc.groupBy(key, "sector").agg(*(F.min(m).alias(m) for m in meta))
    both = per.groupBy(key).agg(F.count("*").alias("n"), *(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sector", F.col(m).cast("string").alias("m")))), lambda x: x["m"]), ",").alias(f"{m}s") for m in meta))
    return both.join(F.broadcast(sectors)).filter("n = sectors").drop("sectors")


def stitch_if_alike(lc: DataFrame, meta: list[str], cutoff: float = 0.5, order: int = 5, tol: float = 0.6, key: str = "obj_id") -> tuple[DataFrame, DataFrame]:
    """The samples of objects whose sectors' high-passed RMS differ by less than tol of the lesser, and the rejected.

    Each sector is standardised first (C3); metadata are joined by commas. The rejected are the other objects that are
    in all sectors: (key, low, high)."""
    unit = standardize(lc.filter("flux is not null"), (key, "sector"))

    def one(k: tuple, series: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [k[0]], "sector": [k[1]], "noise": [high_passed_rms(series.sort_values("t")["flux"].to_numpy(float), cutoff, order)]})

    noise = unit.select(key, "sector", "t", "flux").groupBy(key, "sector").applyInPandas(one, f"{key} long, sector int, noise double")
    noise = noise.withColumn("noise", F.when(~F.isnan("noise"), F.col("noise")))
    per = noise.groupBy(key).agg(F.min("noise").alias("low"), F.max("noise").alias("high"), F.count("noise").alias("known"))
    both = per.join(_in_all_sectors(lc, meta, key), key)
    alike = (F.col("known") == F.col("n")) & (F.col("high") - F.col("low") < tol * F.col("low"))
    names = [f"{m}s" for m in meta]
    good = unit.join(both.filter(alike).select(key, *names), key)
    return good, both.filter(~F.coalesce(alike, F.lit(False))).select(key, "low", "high")


def cut_to_shortest(lc: DataFrame, keys: tuple[str, ...] = ("obj_id", "sector")) -> DataFrame:
    """Every series keeps its first samples, as many as the shortest series has."""
    sizes = lc.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.min("n").alias("shortest"))
    ranked = lc.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("t")))
    return ranked.join(F.broadcast(sizes)).filter("rank <= shortest").drop("shortest")


def first_sectors(lc: DataFrame, timescale: int, key: str = "obj_id") -> DataFrame:
    """An object's first sectors, each divided by its median."""
    ranked = lc.withColumn("nth", F.dense_rank().over(_ordered(key, "sector"))).filter(F.col("nth") <= timescale).drop("nth")
    w = Window.partitionBy(key, "sector")
    return ranked.withColumn("flux", F.try_divide("flux", F.median("flux").over(w)))


def equal_bins(lc: DataFrame, bins: int, key: str = "obj_id") -> DataFrame:
    """Means of `bins` bins of equal count, and of what remains."""
    w = _ordered(key, "t")
    ranked = lc.withColumn("rank", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    size = F.greatest(F.floor(F.col("n") / bins), F.lit(1))
    return ranked.withColumn("bin", F.floor(F.col("rank") / size)).groupBy(key, "bin").agg(F.avg("t").alias("t"), F.avg("flux").alias("flux"))


def truncate(lc: DataFrame, factor: int, last: bool = True, key: str = "obj_id") -> DataFrame:
    """Cut to a multiple of the factor, keeping the last (or first) samples."""
    order = F.desc("t") if last else F.asc("t")
    ranked = lc.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return ranked.filter(F.col("rank") <= F.col("n") - F.col("n") % factor).drop("rank", "n")


def segments(lc: DataFrame, parts: int, len_var: float = 0.0, seed: int = 0, factor: int = 1, key: str = "obj_id") -> DataFrame:
    """Each series cut into `parts` segments of about equal length (bounds moved by up to len_var of it), each cut
    to a multiple of factor; columns `segment` and `z`, the flux standardised in its segment."""
    rng = np.random.default_rng(seed)
    bounds = [(k + 1 + float(rng.uniform(-len_var, len_var))) / parts for k in range(parts - 1)]
    place = (F.row_number().over(_ordered(key, "t")) - 1) / F.count("*").over(Window.partitionBy(key))
    segment = sum((F.when(place >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    w = Window.partitionBy(key, "segment")
    ranked = lc.withColumn("segment", segment).withColumns({"_rank": F.row_number().over(w.orderBy("t")), "_n": F.count("*").over(w)})
    cut = ranked.filter(F.col("_rank") <= F.col("_n") - F.col("_n") % factor).drop("_rank", "_n")
    return standardize(cut.withColumn("z", F.col("flux")), (key, "segment"), "z")


def segment_rms(lc: DataFrame, parts: int, len_var: float = 0.0, seed: int = 0, factor: int = 1, key: str = "obj_id") -> DataFrame:
    """(key, segment, n, rms): the RMS of the flux itself in each segment."""
    return segments(lc, parts, len_var, seed, factor, key).groupBy(key, "segment").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("flux") * F.col("flux"))).alias("rms"))


def running_median(table: DataFrame, columns: list[str], by: str, part: str, width: int = 31) -> DataFrame:
    """Medians of `width` samples of each stretch `part`, zeros beyond both ends."""
    half = width // 2
    w = Window.partitionBy(part).orderBy(by).rowsBetween(-half, half)
    out = table
    for c in columns:
        got = F.collect_list(F.col(c).cast("double")).over(w)
        out = out.withColumn(f"{c}_smooth", F.sort_array(F.concat(got, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(got))))[half])
    return out


def attitude_outlier_bins(table: DataFrame, columns: list[str], t0: float, size: int = 900, sigma: float = 5.0, part: str | None = None) -> DataFrame:
    """From the sample nearest to t0 on, means of full bins of `size` samples (bin time: its first sample); bins
    beyond mean +- sigma deviations in any channel. With `part` each stretch has its own start, bins and statistics.

    A bin at the limit itself is not beyond it, whichever way the sums of doubles round: ROUNDING of mean and limit is let by."""
    keys = [part] if part else []

    def meet(rows: DataFrame, facts: DataFrame) -> DataFrame:
        return rows.join(facts.withColumnRenamed(part, "_part"), F.col(part).eqNullSafe(F.col("_part"))).drop("_part") if part else rows.join(F.broadcast(facts))

    start = table.groupBy(*keys).agg(F.min_by("i", F.struct(F.abs(F.col("t") - t0), F.col("i"))).alias("i0"))
    bins = meet(table, start).filter("i >= i0").withColumn("bin", F.floor((F.col("i") - F.col("i0")) / size))
    means = bins.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min_by("t", "i").alias("t"), *(F.avg(c).alias(c) for c in columns)).filter(F.col("n") == size)
    stats = means.groupBy(*keys).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns))
    limit = {c: sigma * F.col(f"s_{c}") for c in columns}
    odd = [F.abs(F.col(c) - F.col(f"m_{c}")) > limit[c] + ROUNDING * (F.abs(f"m_{c}") + limit[c]) for c in columns]
    any_odd = odd[0]
    for x in odd[1:]:
        any_odd = any_odd | x
    return meet(means, stats).filter(any_odd).select(*keys, "bin", "t", *columns)


def events_inside(lc: DataFrame, events: DataFrame, key: str = "obj_id", cell: float = 1.0) -> DataFrame:
    """Instrument events within the time span of each series. The time axis is cut into cells of so many days: spans
    meet the events of their cells by an equi-join, and are compared after it. A span takes a row for each of its cells."""
    spans = lc.groupBy(key).agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"))
    at = lambda c: F.floor(F.col(c) / cell)
    dealt = spans.withColumn("_cell", F.explode(F.sequence(at("min_t"), at("max_t"))))
    placed = events.select("event_t").withColumn("_cell", at("event_t"))
    return dealt.join(placed, "_cell").filter(F.col("event_t").between(F.col("min_t"), F.col("max_t"))).select(key, "event_t")
