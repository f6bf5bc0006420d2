"""Masks and filters of series: long tables (obj_id, t, flux, ...), missing samples NULL."""


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mask_flagged(lc: DataFrame, quality: str = "quality", flux: str = "flux") -> DataFrame:
    """B1: flux becomes NULL where the quality flag is set."""
    return lc.withColumn(flux, F.when(F.col(quality) == 0, F.col(flux)))


def only_targets(lc: DataFrame, targets: DataFrame, key: str = "obj_id") -> DataFrame:
    """B1: series of listed targets; Spark broadcasts the list if it is known to be small."""
    return lc.join(targets.select(key).distinct(), key, "left_semi")


def drop_missing(lc: DataFrame, flux: str = "flux") -> DataFrame:
    """B2."""
    return lc.filter(F.col(flux).isNotNull() & ~F.isnan(flux))


def clip_series(flux: np.ndarray, sigma: float) -> np.ndarray:
    """Which samples stay after clipping around the median until nothing more is dropped."""
    keep = ~np.isnan(flux)
    while keep.any():
        middle, spread = np.median(flux[keep]), np.std(flux[keep])
        now = keep & (np.abs(flux - middle) <= sigma * spread)
        if now.sum() == keep.sum():
            break
        keep = now
    return keep


def sigma_clip(lc: DataFrame, sigma: float, mode: str = "null", key: str = "obj_id") -> DataFrame:
    """Iterative clip per object; mode null (value becomes NULL), drop (sample goes) or mean (series mean)."""
    if mode not in ("null", "drop", "mean"):
        raise ValueError(mode)

    def clip(series: pd.DataFrame) -> pd.DataFrame:
        flux = series["flux"].to_numpy(float)
        keep = clip_series(flux, sigma)
        if mode == "drop":
            return series[keep | np.isnan(flux)]
        out = np.nanmean(flux) if mode == "mean" and len(flux) and not np.isnan(flux).all() else np.nan
        return series.assign(flux=np.where(keep, flux, np.where(np.isnan(flux), np.nan, out)))

    got = lc.groupBy(key).applyInPandas(clip, lc.schema)
    return got.withColumn("flux", F.when(~F.isnan("flux"), F.col("flux")))


def sigma_clip_once(lc: DataFrame, sigma: float, key: str = "obj_id") -> DataFrame:
    """B3 in one pass, all built-in: NULL beyond sigma population deviations around the median."""
    w = Window.partitionBy(key)
    beyond = F.abs(F.col("flux") - F.median("flux").over(w)) > sigma * F.stddev_pop("flux").over(w)
    return lc.withColumn("flux", F.when(~beyond, F.col("flux")))


def drop_index_ranges(lc: DataFrame, ranges: list[tuple[int, int]], key: str = "obj_id", t: str = "t") -> DataFrame:
    """Without samples whose index (0-based, by time) lies in one of the fixed ranges [low, high)."""
    index = F.row_number().over(Window.partitionBy(key).orderBy(t)) - 1
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | ((F.col("_index") >= low) & (F.col("_index") < high))
    return lc.withColumn("_index", index).filter(~inside).drop("_index")


def common_time_mask(grid: DataFrame, tol1: float = 0.05, tol2: float = 0.5, key: str = "obj_id", i: str = "i") -> DataFrame:
    """(a) objects with over tol2 * n_points missing go, if there are some but fewer than tol1 * n_objects;
    (b) then each time index where any kept object is missing goes."""
    missing = F.count_if(F.col("flux").isNull())
    by_object = grid.groupBy(key).agg(missing.alias("missing"), F.count("*").alias("points"))
    judged = by_object.withColumn("bad", F.col("missing") > tol2 * F.col("points"))
    total = judged.agg(F.count_if("bad").alias("n_bad"), F.count("*").alias("n"))  # one row
    drop = judged.filter("bad").join(F.broadcast(total.filter((F.col("n_bad") > 0) & (F.col("n_bad") < tol1 * F.col("n")))))
    kept = grid.join(drop.select(key), key, "left_anti")
    full = kept.groupBy(i).agg(F.count_if(F.col("flux").isNull()).alias("holes")).filter("holes = 0")
    return kept.join(full.select(i), i, "left_semi")


def by_camera_ccd(targets: DataFrame, camera: int, ccd: int) -> DataFrame:
    """B6."""
    return targets.filter((F.col("camera") == camera) & (F.col("ccd") == ccd))


def brightest(catalog: DataFrame, low: float, high: float, n: int, kind: str, mag: str = "Tmag") -> DataFrame:
    """The first n objects of a kind by magnitude within a range (ties by id)."""
    return catalog.filter(F.col(mag).between(low, high) & (F.col("objType") == kind)).orderBy(mag, "ID").limit(n)


def short_transits(table: DataFrame, hours: float, duration: str = "duration") -> DataFrame:
    """Duration in (0, hours / 24) days."""
    return table.filter((F.col(duration) > 0) & (F.col(duration) < hours / 24))
