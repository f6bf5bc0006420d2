"""Queries on series: sources, masks, normalisation, time axes, series features."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sources
from ..functions.transits import dip
from ..operators import clean, features, neighbors, normalize, timeaxis
from . import views as v
from .registry import Registry, rounded

REGISTRY = query = Registry()
R = lambda x, name: f"round({x}, 6) + 0.0 AS {name}"


def most_variable(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """Which objects vary most after cleaning: A1, B1, B2, C1, E9, G4."""
    lc = clean.drop_missing(clean.mask_flagged(v.lc(spark, sf_dir)))
    scores = features.variability(lc).withColumnRenamed("variability", "lof")
    return rounded(neighbors.pick(scores, n, "most").withColumnRenamed("lof", "variability"), "variability")


VARIABILITY = f"{v.OK}, u AS (SELECT obj_id, flux / median(flux) OVER (PARTITION BY obj_id) AS x FROM ok), vs AS (SELECT obj_id, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS variability FROM u GROUP BY obj_id)"
query("w0_most_variable", f"WITH {VARIABILITY} SELECT obj_id, {R('variability', 'variability')} FROM vs ORDER BY vs.variability DESC, obj_id LIMIT 10")(most_variable)


@query("a1_a8_sector_partition", f"WITH {v.OK} SELECT obj_id, count(*) AS n, {R('max(flux)', 'top')} FROM ok WHERE sector = 2 GROUP BY obj_id")
def a1(spark, d):
    lc = v.series_table(spark, d)
    return rounded(sources.read_sector(lc, 2).groupBy("obj_id").agg(F.count("*").alias("n"), F.max("flux").alias("top")), "top")


CHAIN = f"""WITH {v.OK}, u AS (SELECT obj_id, sector, t, flux / median(flux) OVER (PARTITION BY obj_id) AS y FROM ok),
 ob AS (SELECT obj_id FROM u GROUP BY 1 HAVING count(DISTINCT sector) = (SELECT count(DISTINCT sector) FROM u)),
 x AS (SELECT obj_id, (y - min(y) OVER w) / nullif(max(y) OVER w - min(y) OVER w, 0) AS z FROM u JOIN ob USING (obj_id) WINDOW w AS (PARTITION BY obj_id, sector))
 SELECT obj_id, count(*) AS n, {R("avg(z)", "mean")}, {R("var_pop(z)", "m2")} FROM x GROUP BY 1"""


@query("a8_stored_chain", CHAIN)
def a8(spark, d):
    """B1, B2, C1, D7 and E1 on a bucketed table: no exchange by object."""
    lc = clean.drop_missing(clean.mask_flagged(v.series_table(spark, d, masked=False)))
    whole = timeaxis.stitch(normalize.by_median(lc), ["quality"])
    out = whole.groupBy("obj_id").agg(F.count("*").alias("n"), F.avg("flux").alias("mean"), F.var_pop("flux").alias("m2"))
    return rounded(out, "mean", "m2")


@query("a2_labelled_series", f"WITH {v.OK} SELECT concat('s', sector, 'q', obj_id % 3) AS label, count(*) AS n, {R('sum(flux)', 'total')} FROM ok GROUP BY 1")
def a2(spark, d):
    path = sources.shared_folder(spark, "rflx")
    name = F.concat(F.lit("rflx_s"), F.col("sector"), F.lit("_q"), F.col("obj_id") % 3)
    v.ok(spark, d).select("t", "flux", F.lit(0.0).alias("error"), name.alias("name")).write.partitionBy("name").option("sep", " ").csv(path)
    return rounded(sources.read_labelled_series(spark, path).groupBy("label").agg(F.count("*").alias("n"), F.sum("intensity").alias("total")), "total")


@query("a3_cleaned_series", f"WITH {v.OK} SELECT obj_id, count(*) AS n, {R('sum(flux)', 'total')} FROM ok GROUP BY 1")
def a3(spark, d):
    path = sources.shared_folder(spark, "lc")
    sources.write_cleaned_series(v.ok(spark, d), path)
    return rounded(sources.read_cleaned_series(spark, path).groupBy("obj_id").agg(F.count("*").alias("n"), F.sum("flux").alias("total")), "total")


@query("a4_catalog_csv", f"WITH {v.CATALOG} SELECT objType, count(*) AS n, {R('sum(ra)', 'ra')} FROM catalog GROUP BY 1")
def a4(spark, d):
    path = sources.shared_folder(spark, "catalog")
    v.catalog(spark, d).drop("sector").write.option("header", True).csv(path)
    got = sources.read_catalog(spark, path, "ID long, ra double, dec double, Tmag double, objType string")
    return rounded(got.groupBy("objType").agg(F.count("*").alias("n"), F.sum("ra").alias("ra")), "ra")


@query("a5_label_files", f"WITH {v.TYPES} SELECT id, nullif(otype, '') AS otype FROM types")
def a5(spark, d):
    path = sources.shared_folder(spark, "labels")
    v.raw_types(spark, d).withColumn("main_id", F.lit("x")).write.csv(path)
    return sources.read_labels(spark, path).select("id", F.expr("nullif(otype, '')").alias("otype"))


@query("a6_descriptions", "SELECT DISTINCT regexp_replace(p_type, '[:?*]$', '') AS otype, concat('kind ', p_type) AS description FROM part")
def a6(spark, d):
    path = sources.shared_folder(spark, "descriptions")
    kind = v.table(spark, d, "part").select("p_type").distinct()
    kind.select(F.concat("p_type", F.lit(": = kind "), "p_type")).write.text(path)
    return sources.read_descriptions(spark, path)


@query("a7_event_times", "SELECT o_orderkey % 30 + 0.5 AS event_t FROM orders")
def a7(spark, d):
    path = sources.shared_folder(spark, "events")
    lines = v.table(spark, d, "orders").select(F.concat_ws(" ", F.lit("a b c"), F.concat((F.col("o_orderkey") % 30 + 0.5).cast("string"), F.lit(","))).alias("value"), F.pmod("o_orderkey", F.lit(8)).alias("file"), F.lit(1).alias("part"))
    header = spark.range(48).select(F.lit("# header no 9.5,").alias("value"), F.pmod("id", F.lit(8)).alias("file"), F.lit(0).alias("part"))
    text = header.unionByName(lines).repartition("file").sortWithinPartitions("file", "part").select("file", "value")
    text.write.partitionBy("file").text(path)
    return sources.read_event_times(spark, path).select(F.col("event_t"))


@query("a9_a10_scores_aligned", f"WITH {v.OK}, s AS (SELECT obj_id, count(*) AS n FROM ok WHERE obj_id % 2 = 0 GROUP BY 1) SELECT o.obj_id, s.n, CASE WHEN s.n IS NULL THEN 1 ELSE 0 END AS missing FROM (SELECT DISTINCT obj_id FROM lc) o LEFT JOIN s ON o.obj_id = s.obj_id")
def a9(spark, d):
    path = sources.shared_folder(spark, "scores")
    sources.write_scores(v.ok(spark, d).filter("obj_id % 2 = 0").groupBy("obj_id").agg(F.count("*").alias("n")), path)
    return sources.read_aligned(spark, path, v.lc(spark, d).select("obj_id"))


@query("b1_quality_mask", f"WITH {v.LC} SELECT obj_id, count(*) AS n, count(CASE WHEN quality = 0 THEN 1 END) AS kept, {R('avg(CASE WHEN quality = 0 THEN flux END)', 'mean')} FROM lc WHERE obj_id % 4 + 1 = 2 GROUP BY obj_id")
def b1(spark, d):
    lc = clean.only_targets(clean.mask_flagged(v.lc(spark, d)), v.targets(spark, d).filter("camera = 2"))
    return rounded(lc.groupBy("obj_id").agg(F.count("*").alias("n"), F.count("flux").alias("kept"), F.avg("flux").alias("mean")), "mean")


@query("b2_drop_missing", f"WITH {v.OK} SELECT sector, count(*) AS n FROM ok GROUP BY 1")
def b2(spark, d):
    return clean.drop_missing(clean.mask_flagged(v.lc(spark, d))).groupBy("sector").agg(F.count("*").alias("n"))


@query("b3_sigma_clip_once", f"WITH {v.OK}, s AS (SELECT obj_id, flux, median(flux) OVER w AS m, stddev_pop(flux) OVER w AS s FROM ok WINDOW w AS (PARTITION BY obj_id)) SELECT obj_id, count(*) AS n, count(CASE WHEN abs(flux - m) <= 2 * s THEN 1 END) AS kept FROM s GROUP BY obj_id")
def b3(spark, d):
    return clean.sigma_clip_once(v.ok(spark, d), 2.0).groupBy("obj_id").agg(F.count("*").alias("n"), F.count("flux").alias("kept"))


def clip_sql(rounds: int, sigma: float) -> str:
    parts = [f"c0 AS (SELECT obj_id, flux FROM ok)"]
    for k in range(rounds):
        parts.append(f"c{k + 1} AS (SELECT obj_id, flux FROM c{k} QUALIFY abs(flux - median(flux) OVER (PARTITION BY obj_id)) <= {sigma} * stddev_pop(flux) OVER (PARTITION BY obj_id))")
    return ", ".join(parts)


@query("b3_sigma_clip", f"WITH {v.OK}, {clip_sql(40, 2.5)} SELECT obj_id, count(*) AS kept, {R('sum(flux)', 'total')} FROM c40 GROUP BY obj_id")
def b3_full(spark, d):
    return rounded(clean.sigma_clip(sources.dealt(v.ok(spark, d)), 2.5, "drop").groupBy("obj_id").agg(F.count("*").alias("kept"), F.sum("flux").alias("total")), "total")


@query("b4_index_ranges", f"WITH {v.OK}, r AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY t) - 1 AS k FROM ok) SELECT obj_id, count(*) AS n, {R('sum(flux)', 'total')} FROM r WHERE NOT (k >= 3 AND k < 10) AND NOT (k >= 20 AND k < 25) GROUP BY 1")
def b4(spark, d):
    return rounded(clean.drop_index_ranges(v.ok(spark, d), [(3, 10), (20, 25)]).groupBy("obj_id").agg(F.count("*").alias("n"), F.sum("flux").alias("total")), "total")


@query("b5_common_time_mask", f"""WITH {v.grid_sql(3)}, b AS (SELECT obj_id, count(*) FILTER (flux IS NULL) > 0.05 * count(*) AS bad FROM grid GROUP BY 1),
 g AS (SELECT count(*) FILTER (bad) AS nb, count(*) AS n FROM b), k AS (SELECT grid.* FROM grid JOIN b USING (obj_id) CROSS JOIN g WHERE NOT (bad AND nb > 0 AND nb < 0.2 * n))
 SELECT obj_id, i, {R('flux', 'flux')} FROM k WHERE i NOT IN (SELECT i FROM k WHERE flux IS NULL)""")
def b5(spark, d):
    return rounded(clean.common_time_mask(v.grid(spark, d, 3), 0.2, 0.05), "flux")


@query("b6_camera_ccd", f"WITH {v.TARGETS} SELECT * FROM targets WHERE camera = 2 AND ccd = 3")
def b6(spark, d):
    return clean.by_camera_ccd(v.targets(spark, d), 2, 3)


@query("b7_brightest", f"WITH {v.CATALOG} SELECT ID, Tmag FROM catalog WHERE Tmag BETWEEN 2 AND 8 AND objType = 'MACHINERY' ORDER BY Tmag, ID LIMIT 25")
def b7(spark, d):
    return clean.brightest(v.catalog(spark, d), 2, 8, 25, "MACHINERY").select("ID", "Tmag")


@query("b8_short_transits", "SELECT l_orderkey, l_linenumber, l_quantity / 100 AS duration FROM lineitem WHERE l_quantity / 100 > 0 AND l_quantity / 100 < 5.0 / 24")
def b8(spark, d):
    return clean.short_transits(v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 100).alias("duration")), 5.0)


def per_sample(name: str, expr: str, f) -> None:
    sql = f"WITH {v.OK} SELECT obj_id, round(t, 6) AS t, round({expr}, 6) + 0.0 AS flux FROM ok WINDOW w AS (PARTITION BY obj_id), ws AS (PARTITION BY obj_id, sector)"
    query(name, sql)(lambda spark, d: rounded(f(v.ok(spark, d)), "flux").select("obj_id", F.round("t", 6).alias("t"), "flux"))


per_sample("c1_by_median", "flux / median(flux) OVER w - 1", lambda lc: normalize.by_median(lc, minus_one=True))
per_sample("c2_by_mean", "flux / avg(flux) OVER w", normalize.by_mean)
per_sample("c3_standardize", "(flux - avg(flux) OVER w) / stddev_pop(flux) OVER w", normalize.standardize)
per_sample("c4_min_max", "(flux - min(flux) OVER w) / (max(flux) OVER w - min(flux) OVER w) * 3 - 1", lambda lc: normalize.min_max(lc, -1.0, 2.0))
per_sample("c7_detrend", "flux - (regr_slope(flux, t) OVER ws * t + regr_intercept(flux, t) OVER ws)", normalize.detrend)


@query("c3_standardize_columns", f"WITH {v.LC} SELECT obj_id, {R('(flux - (SELECT avg(flux) FROM lc)) / (SELECT stddev_pop(flux) FROM lc)', 'flux')}, {R('(t - (SELECT avg(t) FROM lc)) / (SELECT stddev_pop(t) FROM lc)', 't')} FROM lc")
def c3_columns(spark, d):
    return rounded(normalize.standardize_columns(v.lc(spark, d).select("obj_id", "flux", "t"), ["flux", "t"]), "flux", "t")


@query("c5_robust_columns", f"WITH {v.LC} SELECT obj_id, {R('(flux - (SELECT median(flux) FROM lc)) / (SELECT quantile_cont(flux, 0.75) - quantile_cont(flux, 0.25) FROM lc)', 'flux')} FROM lc")
def c5(spark, d):
    return rounded(normalize.robust_columns(v.lc(spark, d).select("obj_id", "flux"), ["flux"]), "flux")


@query("c6_rms", f"WITH {v.OK} SELECT obj_id, {R('sqrt(avg(flux * flux))', 'rms')} FROM ok GROUP BY 1")
def c6(spark, d):
    return rounded(normalize.rms(v.ok(spark, d)), "rms")


RUNS = """h AS (SELECT obj_id, i, i - row_number() OVER (PARTITION BY obj_id ORDER BY i) AS island FROM grid WHERE flux IS NULL),
 runs AS (SELECT obj_id, min(i) AS start, count(*) AS length FROM h GROUP BY obj_id, island)"""


@query("d1_missing_runs", f"WITH {v.grid_sql(1)}, {RUNS} SELECT * FROM runs")
def d1(spark, d):
    return timeaxis.missing_runs(v.grid(spark, d, 1))


@query("d2_cadence", f"WITH {v.LC}, s AS (SELECT obj_id, t - lag(t) OVER (PARTITION BY obj_id ORDER BY t) AS step FROM lc) SELECT obj_id, {R('min(step)', 'cadence')} FROM s WHERE step > 0 GROUP BY 1")
def d2(spark, d):
    return rounded(timeaxis.cadence(v.lc(spark, d)), "cadence")


@query("d3_classify_runs", f"""WITH {v.grid_sql(1)}, {RUNS}, e AS (SELECT obj_id, min(i) AS a, max(i) AS b FROM grid GROUP BY 1),
 r AS (SELECT runs.*, CASE WHEN start = a THEN 'leading' WHEN start + length - 1 = b THEN 'trailing' END AS edge FROM runs JOIN e USING (obj_id))
 SELECT obj_id, start, length, coalesce(edge, CASE WHEN row_number() OVER (PARTITION BY obj_id, edge IS NULL ORDER BY length DESC, start) = 1 THEN 'orbit' ELSE 'gap' END) AS kind FROM r""")
def d3(spark, d):
    return timeaxis.classify_runs(v.grid(spark, d, 1))


@query("d4_fill_linear", f"""WITH {v.grid_sql(1)}, k AS (SELECT *, last_value(CASE WHEN flux IS NOT NULL THEN i END IGNORE NULLS) OVER p AS bi, last_value(flux IGNORE NULLS) OVER p AS bf,
 first_value(CASE WHEN flux IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ai, first_value(flux IGNORE NULLS) OVER n AS af FROM grid
 WINDOW p AS (PARTITION BY obj_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY obj_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT obj_id, i, {R('coalesce(flux, CASE WHEN ai - bi - 1 < 3 THEN bf + (af - bf) * (i - bi) / (ai - bi) END)', 'flux')} FROM k""")
def d4(spark, d):
    return rounded(timeaxis.fill_linear(v.grid(spark, d, 1), 3), "flux")


@query("d4_interpolate")
def d4_full(spark, d):
    return rounded(timeaxis.interpolate(v.grid(spark, d, 1).withColumnRenamed("i", "t").select("obj_id", F.col("t").cast("double").alias("t"), "flux"), tol_days=1.5, sigma=10.0), "flux")


@query("d5_fill_times", f"WITH {v.LC}, a AS (SELECT CAST(floor(t) AS BIGINT) AS i, min(t) AS t FROM lc GROUP BY 1), g AS (SELECT i, CASE WHEN i % 5 <> 2 THEN t END AS t FROM a), k AS (SELECT *, lag(t) OVER (ORDER BY i) AS b, lead(t) OVER (ORDER BY i) AS f FROM g) SELECT i, {R('coalesce(t, (b + f) / 2)', 't')} FROM k")
def d5(spark, d):
    axis = v.lc(spark, d).groupBy(F.floor("t").alias("i")).agg(F.min("t").alias("t"))
    return rounded(timeaxis.fill_times(axis.withColumn("t", F.when(F.col("i") % 5 != 2, F.col("t")))), "t")


@query("d6_largest_gap", f"""WITH {v.OK}, g AS (SELECT obj_id, t, lead(t) OVER (PARTITION BY obj_id ORDER BY t) - t AS gap FROM ok), e AS (SELECT obj_id, t AS gap_start FROM g QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY gap DESC NULLS LAST, t) = 1)
 SELECT obj_id, CASE WHEN t <= gap_start THEN 0 ELSE 1 END AS part, count(*) AS n FROM ok JOIN e USING (obj_id) GROUP BY ALL""")
def d6(spark, d):
    return timeaxis.split_at_largest_gap(v.ok(spark, d)).groupBy("obj_id", "part").agg(F.count("*").alias("n"))


@query("d7_stitch", f"""WITH {v.OK}, b AS (SELECT obj_id, string_agg(CAST(camera AS VARCHAR), ',' ORDER BY sector) AS cameras FROM (SELECT DISTINCT obj_id, sector, sector * 10 + obj_id % 3 AS camera FROM ok) GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sector) FROM ok)),
 s AS (SELECT obj_id, sector, (flux - min(flux) OVER w) / nullif(max(flux) OVER w - min(flux) OVER w, 0) AS flux FROM ok WINDOW w AS (PARTITION BY obj_id, sector))
 SELECT obj_id, cameras, count(*) AS n, {R('sum(flux)', 'total')} FROM s JOIN b USING (obj_id) GROUP BY 1, 2""")
def d7(spark, d):
    lc = v.ok(spark, d)
    got = timeaxis.stitch(lc.withColumn("camera", F.col("sector") * 10 + F.col("obj_id") % 3), ["camera"])
    return rounded(got.groupBy("obj_id", "cameras").agg(F.count("*").alias("n"), F.sum("flux").alias("total")), "total")


@query("d8_stitch_if_alike")
def d8(spark, d):
    """An object a row: its stitched series in sums, or that it was rejected (tests/test_helpers.py has a plain version)."""
    good, rejected = timeaxis.stitch_if_alike(v.ok(spark, d).withColumn("name", F.col("sector")), ["name"])
    kept = good.groupBy("obj_id", "names").agg(F.count("*").alias("n"), F.sum(F.col("flux") * F.col("t")).alias("moment"))
    return rounded(kept.unionByName(rejected.select("obj_id"), allowMissingColumns=True), "moment")


@query("d9_cut_to_shortest", f"""WITH {v.OK}, r AS (SELECT *, row_number() OVER (PARTITION BY obj_id, sector ORDER BY t) AS k FROM ok), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ok GROUP BY obj_id, sector))
 SELECT obj_id, sector, count(*) AS n, {R('sum(flux)', 'total')} FROM r, m WHERE k <= m.n GROUP BY obj_id, sector""")
def d9(spark, d):
    return rounded(timeaxis.cut_to_shortest(v.ok(spark, d)).groupBy("obj_id", "sector").agg(F.count("*").alias("n"), F.sum("flux").alias("total")), "total")


@query("d10_first_sectors", f"WITH {v.OK}, s AS (SELECT *, dense_rank() OVER (PARTITION BY obj_id ORDER BY sector) AS k, flux / median(flux) OVER (PARTITION BY obj_id, sector) AS x FROM ok) SELECT obj_id, sector, count(*) AS n, {R('sum(x)', 'total')} FROM s WHERE k <= 1 GROUP BY ALL")
def d10(spark, d):
    return rounded(timeaxis.first_sectors(v.ok(spark, d), 1).groupBy("obj_id", "sector").agg(F.count("*").alias("n"), F.sum("flux").alias("total")), "total")


@query("d11_equal_bins", f"""WITH {v.OK}, r AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY obj_id) AS n FROM ok)
 SELECT obj_id, CAST(k // greatest(n // 8, 1) AS BIGINT) AS bin, {R('avg(t)', 't')}, {R('avg(flux)', 'flux')} FROM r GROUP BY 1, 2""")
def d11(spark, d):
    return rounded(timeaxis.equal_bins(v.ok(spark, d), 8), "t", "flux")


@query("d12_truncate", f"WITH {v.OK}, r AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY t DESC) AS k, count(*) OVER (PARTITION BY obj_id) AS n FROM ok) SELECT obj_id, count(*) AS n, {R('min(t)', 'first')} FROM r WHERE k <= n - n % 8 GROUP BY 1")
def d12(spark, d):
    return rounded(timeaxis.truncate(v.ok(spark, d), 8).groupBy("obj_id").agg(F.count("*").alias("n"), F.min("t").alias("first")), "first")


@query("d13_segment_rms", f"""WITH {v.OK}, r AS (SELECT *, (row_number() OVER (PARTITION BY obj_id ORDER BY t) - 1) / count(*) OVER (PARTITION BY obj_id) AS p FROM ok), s AS (SELECT *, CASE WHEN p >= 0.25 THEN 1 ELSE 0 END + CASE WHEN p >= 0.5 THEN 1 ELSE 0 END + CASE WHEN p >= 0.75 THEN 1 ELSE 0 END AS segment FROM r),
 g AS (SELECT *, row_number() OVER (PARTITION BY obj_id, segment ORDER BY t) AS k, count(*) OVER (PARTITION BY obj_id, segment) AS m FROM s) SELECT obj_id, segment, count(*) AS n, {R('sqrt(avg(flux * flux))', 'rms')} FROM g WHERE k <= m - m % 3 GROUP BY 1, 2""")
def d13(spark, d):
    return rounded(timeaxis.segment_rms(v.ok(spark, d), 4, factor=3), "rms")


@query("d13_segments", f"""WITH {v.OK}, r AS (SELECT *, (row_number() OVER (PARTITION BY obj_id ORDER BY t) - 1) / count(*) OVER (PARTITION BY obj_id) AS p FROM ok), s AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS segment FROM r)
 SELECT obj_id, segment, {R('t', 't')}, {R('(flux - avg(flux) OVER w) / CASE WHEN stddev_pop(flux) OVER w = 0 THEN 1e-8 ELSE stddev_pop(flux) OVER w END', 'z')} FROM s WINDOW w AS (PARTITION BY obj_id, segment)""")
def d13_segments(spark, d):
    return rounded(timeaxis.segments(v.ok(spark, d), 2).select("obj_id", "segment", "t", "z"), "t", "z")


def attitude(spark, d):
    t = v.table(spark, d, "lineitem")
    i = F.row_number().over(Window.partitionBy("stretch").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")) - 1
    rows = t.withColumn("stretch", F.col("l_suppkey")).withColumn("i", i)
    return rows.select("stretch", "i", (F.col("i") * 2.0).alias("t"), F.col("l_quantity").cast("double").alias("q1"), F.col("l_discount").cast("double").alias("q2"), F.col("l_tax").cast("double").alias("q3"))


ATT = "att AS (SELECT l_suppkey AS stretch, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i, CAST(l_quantity AS DOUBLE) AS q1, CAST(l_discount AS DOUBLE) AS q2, CAST(l_tax AS DOUBLE) AS q3 FROM lineitem)"


@query("d14_running_median", f"""WITH {ATT}, c AS (SELECT stretch, i, list(q1) OVER (PARTITION BY stretch ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS l FROM att)
 SELECT stretch, i, {R('list_sort(list_concat(l, list_resize(CAST([] AS DOUBLE[]), 31 - len(l), 0.0)))[16]', 'q1_smooth')} FROM c""")
def d14(spark, d):
    return rounded(timeaxis.running_median(attitude(spark, d), ["q1"], "i", "stretch").select("stretch", "i", "q1_smooth"), "q1_smooth")


BINS = f"""WITH {ATT}, a AS (SELECT stretch, i, 2.0 * i AS t, q1, q2, q3 FROM att), b AS (SELECT stretch, CAST((i - 10) // 20 AS BIGINT) AS bin, count(*) AS n, min(t) AS t, avg(q1) AS q1, avg(q2) AS q2, avg(q3) AS q3 FROM a WHERE i >= 10 GROUP BY 1, 2 HAVING count(*) = 20),
 s AS (SELECT stretch, avg(q1) AS m1, stddev_pop(q1) AS s1, avg(q2) AS m2, stddev_pop(q2) AS s2, avg(q3) AS m3, stddev_pop(q3) AS s3 FROM b GROUP BY 1) SELECT stretch, bin, {R('t', 't')}, {R('q1', 'q1')}, {R('q2', 'q2')}, {R('q3', 'q3')} FROM b JOIN s USING (stretch) WHERE abs(q1 - m1) > 1.5 * s1 OR abs(q2 - m2) > 1.5 * s2 OR abs(q3 - m3) > 1.5 * s3"""


@query("d15_attitude_bins", BINS)
@query("d15_attitude_bins_all", BINS)
def d15(spark, d):
    return rounded(timeaxis.attitude_outlier_bins(attitude(spark, d), ["q1", "q2", "q3"], 20.4, 20, 1.5, "stretch"), "t", "q1", "q2", "q3")


INSIDE = f"WITH {v.LC}, s AS (SELECT obj_id, min(t) AS a, max(t) AS b FROM lc GROUP BY 1), ev AS (SELECT DISTINCT o_orderkey % 30 + 0.5 AS event_t FROM orders) SELECT obj_id, CAST(event_t AS DOUBLE) AS event_t FROM s JOIN ev ON event_t BETWEEN a AND b"


@query("d16_events_inside", INSIDE)
@query("d16_events_inside_all", INSIDE)
def d16(spark, d):
    events = v.table(spark, d, "orders").select((F.col("o_orderkey") % 30 + F.lit(0.5)).cast("double").alias("event_t")).distinct()
    return timeaxis.events_inside(v.lc(spark, d), events)


MOMENTS = f"""m AS (SELECT obj_id, t, flux, flux - avg(flux) OVER (PARTITION BY obj_id) AS d FROM ok), mo AS (SELECT obj_id, avg(flux) AS mean, avg(d ** 2) AS m2, avg(d ** 3) AS m3, avg(d ** 4) AS m4 FROM m GROUP BY 1)"""


@query("e1_moments", f"WITH {v.OK}, {MOMENTS} SELECT obj_id, {R('mean', 'mean')}, {R('m2', 'm2')}, {R('m3', 'm3')}, {R('m4', 'm4')}, {R('ln(abs(m2))', 'ln_m2')}, {R('ln(abs(m3))', 'ln_m3')}, {R('ln(abs(m4))', 'ln_m4')} FROM mo")
def e1(spark, d):
    return rounded(features.moments(v.ok(spark, d)), *features.MOMENTS)


@query("e3_trend", f"WITH {v.OK} SELECT obj_id, {R('regr_slope(flux, t)', 'slope')}, {R('ln(abs(regr_slope(flux, t)))', 'ln_slope')} FROM ok GROUP BY 1")
def e3(spark, d):
    return rounded(features.trend(v.ok(spark, d)), "slope", "ln_slope")


def spectrum_sql(name: str, low: float, high: float, n: int) -> str:
    """Scargle's power of series `u` (obj_id, t, y) at n even angular frequencies: (obj_id, k, w, p)."""
    step = (high - low) / (n - 1)
    return f"""{name}_w AS (SELECT k, {low} + k * {step!r} AS w FROM range({n}) r(k)),
 {name}_s AS (SELECT obj_id, k, w, sum(cos(2 * w * t)) AS c2, sum(sin(2 * w * t)) AS s2, sum(y * cos(w * t)) AS yc, sum(y * sin(w * t)) AS ys, count(*) AS n, sum(y * y) AS yy FROM u, {name}_w GROUP BY 1, 2, 3),
 {name}_a AS (SELECT *, cos(atan2(s2, c2) / 2) AS a, sin(atan2(s2, c2) / 2) AS b FROM {name}_s),
 {name} AS (SELECT obj_id, k, w, ((yc * a + ys * b) ** 2 / ((n + c2) / 2 * a * a + s2 * a * b + (n - c2) / 2 * b * b) + (ys * a - yc * b) ** 2 / ((n - c2) / 2 * a * a - s2 * a * b + (n + c2) / 2 * b * b)) / yy AS p FROM {name}_a WHERE n > 2 AND yy > 0),
 {name}_m AS (SELECT *, lag(p) OVER v AS before, lead(p) OVER v AS after FROM {name} WINDOW v AS (PARTITION BY obj_id ORDER BY k)),
 {name}_k AS (SELECT obj_id, max(p) AS peak, 2 * pi() / arg_max(w, p) AS period FROM {name}_m WHERE p > before AND p > after GROUP BY 1)"""


AREA = ", ".join(f"sum(CASE WHEN k >= {a} AND k < {b - 1} THEN (p + after) / 2 END) * {(10 - 0.1) / 4999!r} AS {name}" for name, a, b in (("area_long", 457, 5000), ("area_middle", 121, 457), ("area_short", 0, 121)))
ENGINEERED = f"""WITH {v.OK}, u AS (SELECT obj_id, t, flux / median(flux) OVER (PARTITION BY obj_id) AS y FROM ok), {MOMENTS.replace("FROM ok", "FROM (SELECT obj_id, t, y AS flux FROM u)")},
 tr AS (SELECT obj_id, regr_slope(y, t) AS slope FROM u GROUP BY 1), {spectrum_sql("sp", 0.6, 62.8, 5000)}, ar AS (SELECT obj_id, {AREA} FROM sp_m GROUP BY 1), {spectrum_sql("fa", 62.8, 6283.2, 20)}
 SELECT obj_id, {", ".join(R(c, c) for c in ("mean", "m2", "m3", "m4"))}, {", ".join(R(f"ln(abs({c}))", f"ln_{c}") for c in ("m2", "m3", "m4"))}, {R("sp_k.peak", "peak_power")}, {R("ln(abs(sp_k.peak))", "ln_peak_power")}, {R("sp_k.period", "peak_period")},
 {R("slope", "slope")}, {R("ln(abs(slope))", "ln_slope")}, {", ".join(R(c, c) for c in ("area_long", "area_middle", "area_short"))}, {R("fa_k.period", "fast_period")} FROM mo JOIN tr USING (obj_id) LEFT JOIN sp_k USING (obj_id) LEFT JOIN ar USING (obj_id) LEFT JOIN fa_k USING (obj_id)"""


@query("e2_e4_e5_e6_engineered", ENGINEERED)
def e6(spark, d):
    out = features.engineered(sources.dealt(v.ok(spark, d)))
    return rounded(out, *out.columns[1:])


@query("e7_transits")
def e7(spark, d):
    out = features.transit_features(sources.dealt(v.ok(spark, d)), v.stars(spark, d))
    return rounded(out, *out.columns[1:])


FOLD_PERIOD, FOLD_WIDTH, FOLD_BINS = 2.75, 9, 128
DIP = ", ".join(f"({j}, {float(q)!r}::DOUBLE)" for j, q in enumerate(dip(FOLD_WIDTH)))
FOLD = f"""WITH {v.OK}, dip(j, q) AS (VALUES {DIP}),
 cells AS (SELECT obj_id, least(CAST(floor((t / {FOLD_PERIOD}) % 1.0::DOUBLE * {FOLD_BINS}) AS BIGINT), {FOLD_BINS - 1}) AS cell, count(*) AS n, sum(flux) AS s FROM ok WHERE flux IS NOT NULL GROUP BY 1, 2),
 lv AS (SELECT obj_id, sum(n) AS total, sum(s) / sum(n) AS mean FROM cells GROUP BY 1),
 st AS (SELECT obj_id, CAST((cell - j + {FOLD_BINS}) % {FOLD_BINS} AS INTEGER) AS bin, sum(q * (n * mean - s)) AS missing, sum(q * q * n) - sum(q * n) ** 2 / max(total) AS spread FROM cells JOIN lv USING (obj_id), dip GROUP BY 1, 2)
 SELECT obj_id, bin, {R("missing * missing / spread", "power")}, {R("missing / spread", "depth")} FROM st WHERE spread > 1e-6 AND missing > 0"""


@query("e7_fold", FOLD)
def e7_fold(spark, d):
    return rounded(features.fold_powers(v.ok(spark, d), FOLD_PERIOD, FOLD_WIDTH, FOLD_BINS), "power", "depth")


@query("e8_power_spectra", f"""WITH {v.OK}, u AS (SELECT obj_id, t, flux - avg(flux) OVER (PARTITION BY obj_id) AS y FROM ok), fr AS (SELECT k, 2 * pi() * (0.05 + 0.01 * k) AS w FROM range(300) r(k)),
 s AS (SELECT obj_id, k, count(*) AS n, sum(cos(w * t)) AS c, sum(sin(w * t)) AS s, sum(cos(w * t) ** 2) AS cc, sum(sin(w * t) ** 2) AS ss, sum(cos(w * t) * sin(w * t)) AS cs, sum(y * cos(w * t)) AS yc, sum(y * sin(w * t)) AS ys, sum(y * y) AS yy FROM u, fr GROUP BY 1, 2),
 z AS (SELECT obj_id, k, cc - c * c / n AS cc, ss - s * s / n AS ss, cs - c * s / n AS cs, yc, ys, yy FROM s WHERE n > 2) SELECT obj_id, CAST(k AS INTEGER) AS k, {R("(ss * yc ** 2 + cc * ys ** 2 - 2 * cs * yc * ys) / ((cc * ss - cs * cs) * yy)", "power")} FROM z""")
def e8(spark, d):
    out = features.power_spectra(sources.dealt(v.ok(spark, d)), [0.05 + 0.01 * k for k in range(300)])
    return rounded(out.select("obj_id", F.posexplode("power").alias("k", "power")).filter("not isnan(power)"), "power")


@query("e9_variability", f"WITH {VARIABILITY} SELECT obj_id, {R('variability', 'variability')} FROM vs")
def e9(spark, d):
    return rounded(features.variability(v.ok(spark, d)), "variability")


@query("e10_join_families", f"WITH {VARIABILITY}, {MOMENTS}, r AS (SELECT obj_id, sqrt(avg(flux * flux)) AS rms FROM ok GROUP BY 1) SELECT obj_id, {R('ln(abs(variability))', 'variability')}, {R('ln(abs(rms))', 'rms')}, {R('ln(abs(m2))', 'm2')} FROM vs JOIN r USING (obj_id) JOIN mo USING (obj_id)")
def e10(spark, d):
    lc = v.ok(spark, d)
    out = features.join_families([features.variability(lc), normalize.rms(lc), features.moments(lc).select("obj_id", "m2")], log=True)
    return rounded(out, *out.columns[1:])


@query("w1_novelty")
def w1(spark, d):
    """Clean, normalise, 16 features, standardise, LOF, the most novel."""
    table = sources.stored(features.engineered(sources.dealt(v.ok(spark, d))), "features")
    columns = table.columns[1:]
    table = normalize.standardize_columns(table.dropna(), columns)
    scores = neighbors.local_outlier_factor(table.select("obj_id", F.array(*columns).alias("features")), 20)
    return rounded(neighbors.pick(scores, 10, "most"), "lof")
