"""Normalisation per series (by key, one column or several) or per feature column."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles

LEAST_SPREAD = 1e-8


def _over(key: str | tuple[str, ...]):
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def by_median(lc: DataFrame, key: str = "obj_id", minus_one: bool = False) -> DataFrame:
    """C1."""
    out = F.try_divide("flux", F.median("flux").over(_over(key)))
    return lc.withColumn("flux", out - 1 if minus_one else out)


def by_mean(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """C2."""
    return lc.withColumn("flux", F.try_divide("flux", F.avg("flux").over(_over(key))))


def scaled(x: Column, mean: Column, spread: Column) -> Column:
    return (x - mean) / F.when(spread == 0, LEAST_SPREAD).otherwise(spread)


def standardize(lc: DataFrame, key: str | tuple[str, ...] = "obj_id", column: str = "flux") -> DataFrame:
    """C3 per series: population deviation, 0 counts as 1e-8."""
    w = _over(key)
    return lc.withColumn(column, scaled(F.col(column), F.avg(column).over(w), F.stddev_pop(column).over(w)))


def standardize_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """C3 per column: one row of statistics meets the table."""
    stats = table.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    joined = table.crossJoin(F.broadcast(stats))
    return joined.select(*(c for c in table.columns if c not in columns), *(scaled(F.col(c), F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(c) for c in columns))


def min_max(lc: DataFrame, low: float = 0.0, high: float = 1.0, key: str = "obj_id") -> DataFrame:
    """C4."""
    w = _over(key)
    a, b = F.min("flux").over(w), F.max("flux").over(w)
    return lc.withColumn("flux", F.try_divide(F.col("flux") - a, b - a) * (high - low) + low)


def robust_columns(table: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / interquartile range."""
    values = table.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("at", "x"))
    found = quantiles(values, ["at"], "x", [0.25, 0.5, 0.75])  # a row a column
    quarters = found.agg(*(F.max(F.when(F.col("at") == i, F.col("quantiles"))).alias(f"_q_{c}") for i, c in enumerate(columns)))
    joined = table.crossJoin(F.broadcast(quarters))
    out = (F.try_divide(F.col(c) - F.col(f"_q_{c}")[1], F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]).alias(c) for c in columns)
    return joined.select(*(c for c in table.columns if c not in columns), *out)


def rms(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """C6."""
    return lc.groupBy(key).agg(F.sqrt(F.avg(F.col("flux") * F.col("flux"))).alias("rms"))


def detrend(lc: DataFrame, keys: tuple[str, ...] = ("obj_id", "sector")) -> DataFrame:
    """Minus the least-squares line per object and sector."""
    w = Window.partitionBy(*keys)
    line = F.regr_slope("flux", "t").over(w) * F.col("t") + F.regr_intercept("flux", "t").over(w)
    return lc.withColumn("flux", F.col("flux") - line)
