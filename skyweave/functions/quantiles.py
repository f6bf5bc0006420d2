"""Exact quantiles of large groups, without a group in one task.

Equal values of a group are counted first (in each task before the shuffle). The counts are sorted in ranges; running
totals within a range and the totals of the ranges before it give the ranks that a value holds, and those that hold a
wanted rank are picked. Quantiles are interpolated between ranks as the built-in `percentile` does it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored


def quantiles(df: DataFrame, by: list[str], value: Column | str, shares: list[float]) -> DataFrame:
    """(by..., quantiles array<double>): of each group's values that are not null, in the order of the shares."""
    groups = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_0")]
    names = [f"_{i}" for i in range(len(groups))]
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*groups, column.cast("double").alias("_value")).filter("_value is not null")
    counts = rows.groupBy(*names, "_value").agg(F.count("*").alias("_n"))
    ranges = counts.repartitionByRange(*names, "_value").withColumn("_range", F.spark_partition_id())
    placed = stored(ranges, "values")
    totals = placed.groupBy(*names, "_range").agg(F.sum("_n").alias("_sum"))
    over = Window.partitionBy(*names)  # a row a range of the group
    before = totals.select(*names, "_range", (F.sum("_sum").over(over.orderBy("_range")) - F.col("_sum")).alias("_before"), F.sum("_sum").over(over).alias("_all"))
    inside = F.sum("_n").over(Window.partitionBy(*names, "_range").orderBy("_value"))
    ranked = placed.withColumn("_upto", inside)
    ranked = ranked.join(before, [ranked[c].eqNullSafe(before[c]) for c in names] + [ranked["_range"] == before["_range"]]).select(*(ranked[c] for c in names), "_value", (F.col("_upto") + F.col("_before")).alias("_end"), "_n", "_all")
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)))).alias("_wanted")
    place = F.col("_wanted.share") * (F.col("_all") - 1)
    held = lambda rank: (rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end"))
    low, high = F.floor(place), F.ceil(place)
    near = ranked.select("*", wanted).filter(held(low) | held(high)).groupBy(*names, "_wanted.at").agg(F.max(F.when(held(low), F.col("_value"))).alias("low"), F.max(F.when(held(high), F.col("_value"))).alias("high"), F.max(place - low).alias("over"))
    between = F.when((F.col("over") == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise((1 - F.col("over")) * F.col("low") + F.col("over") * F.col("high"))
    found = near.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", between.alias("x")))), lambda s: s["x"]).alias("quantiles"))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, by)), "quantiles")
