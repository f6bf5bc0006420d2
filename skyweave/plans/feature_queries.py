"""Queries on feature tables: features, representation, neighbours, clusters."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import cluster, embedding, features, hierarchy, mixture, neighbors, networks, represent
from ..sources import stored
from . import views as v
from .registry import Registry, rounded

REGISTRY = query = Registry()
R = lambda x, name: f"round({x}, 6) + 0.0 AS {name}"


def vectors(spark, d):
    return v.features(spark, d).select("obj_id", "features")


def by_label(spark, d):
    """The true labels serve as a clustering where a query needs one that SQL has too."""
    return v.features(spark, d).select("obj_id", F.col("label").cast("int").alias("cluster"))


def names(spark, d):
    return v.features(spark, d).select("obj_id", "label")


HITS = "st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM fl GROUP BY 1), hits AS (SELECT obj_id, dim, x FROM fl JOIN st USING (dim) WHERE abs(x - m) > 3 * s)"


@query("e11_outlier_hits", f"WITH {v.LONG}, {HITS} SELECT obj_id, dim, {R('x', 'x')} FROM hits")
def e11(spark, d):
    return rounded(features.outlier_hits(vectors(spark, d), 3.0), "x")


@query("e11_without_outliers", f"WITH {v.LONG}, {HITS} SELECT obj_id FROM f WHERE obj_id NOT IN (SELECT obj_id FROM hits)")
def e11_kept(spark, d):
    return features.without_outliers(vectors(spark, d), 3.0).select("obj_id")


@query("e12_correlations", f"WITH {v.FEATURES}, p AS (SELECT i, j, features[i + 1] AS a, features[j + 1] AS b FROM f, range(64) r(i), range(64) s(j) WHERE i <= j) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {R('corr(a, b)', 'corr')} FROM p GROUP BY i, j")
def e12(spark, d):
    return rounded(features.correlations(vectors(spark, d)), "corr")


@query("e13_extremes", f"WITH {v.FEATURES} " + " UNION ".join(f"(SELECT obj_id FROM f ORDER BY features[{k}] {o}, obj_id LIMIT 3)" for k in (1, 3) for o in ("ASC", "DESC")))
def e13(spark, d):
    return features.extremes(vectors(spark, d), (0, 2))


@query("e14_histogram", f"WITH {v.LC}, e AS (SELECT min(flux) AS a, max(flux) AS b FROM lc) SELECT CAST(least(floor((flux - a) / ((b - a) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM lc, e GROUP BY 1")
def e14(spark, d):
    return features.histogram(v.lc(spark, d), "flux", 20)


@query("e14_histogram_2d", f"WITH {v.FEATURES}, xy AS (SELECT features[1] AS x, features[2] AS y FROM f), e AS (SELECT min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM xy) SELECT CAST(least(floor((x - xa) / ((xb - xa) / 8)), 7) AS INTEGER) AS bin_x, CAST(least(floor((y - ya) / ((yb - ya) / 8)), 7) AS INTEGER) AS bin_y, count(*) AS n FROM xy, e GROUP BY 1, 2")
def e14_2d(spark, d):
    return features.histogram_2d(vectors(spark, d), (0, 1), 8)


@query("e15_strongest", f"WITH {v.LONG} SELECT obj_id, dim, {R('x', 'x')}, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY abs(x) DESC, dim) AS INTEGER) AS rank FROM fl QUALIFY rank <= 2")
def e15(spark, d):
    return rounded(features.strongest(vectors(spark, d)), "x")


@query("f1_remove_systematics")
def f1(spark, d):
    rows = v.grid(spark, d, 3).groupBy("obj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("flux", F.lit(0.0)).alias("x")))), lambda x: x["x"]).alias("flux"))
    return represent.remove_systematics(rows, 5).select("obj_id", F.transform("flux", lambda x: F.round(x, 6)).alias("flux"))


@query("f2_pca")
def f2(spark, d):
    return represent.pca(vectors(spark, d), 2).select("obj_id", F.transform("features", lambda x: F.round(x, 6)).alias("features"))


def errors(spark, d):
    table = vectors(spark, d)
    return represent.reconstruction_error(represent.encode(table, *represent.linear_encoder(table, 8)))


@query("f3_f4_reconstruction_error")
def f4(spark, d):
    return rounded(represent.ends_of_error(errors(spark, d), 5), "error", digits=9)


def rule_network() -> list[networks.Layer]:
    """64 numbers to 3 and back, with weights that SQL can write too."""
    j, k = np.arange(64)[:, None], np.arange(3)[None, :]
    return [networks.Layer("dense", "tanh", 1, np.sin(3 * j + k), np.arange(3) / 10), networks.Layer("dense", "linear", 1, np.cos(3 * j + k).T)]


@query("f3_network", f"""WITH {v.FEATURES}, z AS (SELECT obj_id, features, list_transform(range(3), lambda k: tanh(k / 10.0 + list_sum(list_transform(range(64), lambda j: features[j + 1] * sin(3 * j + k))))) AS z FROM f),
 o AS (SELECT obj_id, z, list_avg(list_transform(range(64), lambda j: abs(features[j + 1] - z[1] * cos(3 * j) - z[2] * cos(3 * j + 1) - z[3] * cos(3 * j + 2)))) AS error FROM z)
 SELECT obj_id, {R('z[1]', 'z1')}, {R('z[2]', 'z2')}, {R('z[3]', 'z3')}, {R('error', 'error')} FROM o""")
def f3_network(spark, d):
    out = networks.run_network(vectors(spark, d), networks.layers_of(networks.network_table(spark, rule_network())), 1)
    error = represent.reconstruction_error(out, (1,)).select("obj_id", "error")
    return rounded(out.select("obj_id", *(F.col("bottleneck")[k].alias(f"z{k + 1}") for k in range(3))).join(error, "obj_id"), "z1", "z2", "z3", "error")


@query("f2_map")
def f2_map(spark, d):
    return rounded(embedding.embed(vectors(spark, d)), "y1", "y2", digits=4)


@query("f3_learned_bottleneck")
def f3_learned(spark, d):
    table = stored(vectors(spark, d), "vectors")
    layers = networks.train(table, networks.dense_autoencoder(64, [16, 4]), rounds=5)
    return networks.run_network(table, layers, 2).select("obj_id", F.transform("bottleneck", lambda x: F.round(x, 4)).alias("bottleneck"))


HALF = f"{v.FEATURES}, h AS (SELECT obj_id, unnest(features) AS x FROM f), er AS (SELECT obj_id, avg(abs(x - x / 2) ** p) AS error, CAST(p AS INTEGER) AS power FROM h, range(1, 6) r(p) GROUP BY obj_id, p)"


def half_errors(spark, d):
    table = vectors(spark, d).withColumn("reconstruction", F.transform("features", lambda x: x / 2))
    return represent.reconstruction_error(table)


@query("f4_error_powers", f"WITH {HALF} SELECT obj_id, power, round(error, 9) + 0.0 AS error FROM er")
def f4_powers(spark, d):
    return rounded(half_errors(spark, d), "error", digits=9)


@query("f5_split_by_error", f"WITH {HALF}, c AS (SELECT quantile_cont(error, 0.5) AS cut FROM er WHERE power = 3) SELECT obj_id, CASE WHEN error <= cut THEN 'low' ELSE 'high' END AS part FROM er, c WHERE power = 3")
def f5(spark, d):
    return represent.split_by_error(half_errors(spark, d)).select("obj_id", "part")


for _name, _class in (("f6_split", ""), ("f6_split_stratified", "label")):
    _part = "PARTITION BY label" if _class else ""
    query(_name, f"WITH {v.FEATURES}, r AS (SELECT obj_id, row_number() OVER ({_part} ORDER BY md5(concat(obj_id, ':', 7)), obj_id) AS k, count(*) OVER ({_part}) AS n FROM f) SELECT obj_id, CAST(k <= floor(n * 0.8) AS INTEGER) AS is_train FROM r")(
        lambda spark, d, c=_class: represent.split_train_test(v.features(spark, d), 0.8, 7, c or None).select("obj_id", "is_train")
    )


@query("f7_best_setting", "SELECT p_partkey AS setting, p_retailprice AS loss FROM part WHERE p_partkey % 7 <> 0 ORDER BY loss, setting LIMIT 1")
def f7(spark, d):
    p = v.table(spark, d, "part")
    scan = p.select(F.col("p_partkey").alias("setting"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("loss"))
    return represent.best_setting(scan, "loss")


SQ = "list_sum(list_transform(range(1, len(a.features) + 1), lambda k: (a.features[k] - b.features[k]) ** 2))"
PAIRS = f"{v.FEATURES}, pr AS (SELECT a.obj_id, b.obj_id AS nb_id, sqrt({SQ}) AS dist FROM f a, f b)"
NN = PAIRS + ", nn AS (SELECT * FROM pr WHERE obj_id <> nb_id QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY dist, nb_id) <= 20)"
LOF = """kd AS (SELECT obj_id, max(dist) AS kdist FROM nn GROUP BY 1), lr AS (SELECT nn.obj_id, 1 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.obj_id = nn.nb_id GROUP BY 1),
 lf AS (SELECT nn.obj_id, avg(b.lrd) / any_value(a.lrd) AS lof FROM nn JOIN lr b ON b.obj_id = nn.nb_id JOIN lr a ON a.obj_id = nn.obj_id GROUP BY 1)"""


@query("g1_nearest", f"WITH {NN} SELECT obj_id, nb_id, {R('dist', 'dist')}, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY nn.dist, nb_id) AS INTEGER) AS rank FROM nn QUALIFY rank <= 5")
def g1(spark, d):
    return rounded(neighbors.nearest(vectors(spark, d), 5), "dist")


# Widths by bisection: at each step the half in which the entropy of an object's shares meets that of the perplexity.
@query("g1_affinity_widths", f"""WITH RECURSIVE {NN}, sq AS MATERIALIZED (SELECT obj_id, dist ** 2 - min(dist ** 2) OVER (PARTITION BY obj_id) AS d FROM nn),
 t AS (SELECT 0 AS step, obj_id, CAST(0 AS DOUBLE) AS low, CAST(100000 AS DOUBLE) AS high FROM f
  UNION ALL SELECT step + 1, t.obj_id, CASE WHEN ln(z) + m * e / z > ln(6) THEN m ELSE low END, CASE WHEN ln(z) + m * e / z > ln(6) THEN high ELSE m END
   FROM (SELECT t.step, t.obj_id, any_value(low) AS low, any_value(high) AS high, any_value((low + high) / 2) AS m, sum(exp(-(low + high) / 2 * d)) AS z, sum(d * exp(-(low + high) / 2 * d)) AS e FROM t JOIN sq USING (obj_id) GROUP BY 1, 2) t WHERE step < 60)
 SELECT obj_id, round(low, 4) + 0.0 AS beta FROM t WHERE step = 60""")
def g1_widths(spark, d):
    return rounded(embedding.widths(neighbors.nearest(vectors(spark, d), 20), 6.0).select("obj_id", "beta"), "beta", digits=4)


@query("g1_knee_curve", f"WITH {PAIRS}, k AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY dist, nb_id) <= 10) SELECT obj_id, {R('avg(dist)', 'mean_dist')} FROM k GROUP BY 1")
def g1_knee(spark, d):
    return rounded(neighbors.knee_curve(vectors(spark, d), 10), "mean_dist")


@query("g2_lof", f"WITH {NN}, {LOF} SELECT obj_id, {R('lof', 'lof')} FROM lf")
def g2(spark, d):
    return rounded(neighbors.local_outlier_factor(vectors(spark, d)), "lof")


_A, _B = "a.features[k]", "b.features[k]"
_SUM = lambda x: f"list_sum(list_transform(range(1, len(a.features) + 1), lambda k: {x}))"
#: Distances of a and b by their formulas, by name.
DISTANCES = {
    "euclidean": f"sqrt({_SUM(f'({_A} - {_B}) ** 2')})",
    "cityblock": _SUM(f"abs({_A} - {_B})"),
    "chebyshev": _SUM(f"abs({_A} - {_B})").replace("list_sum", "list_max"),
    "canberra": _SUM(f"coalesce(abs({_A} - {_B}) / nullif(abs({_A}) + abs({_B}), 0), 0)"),
    "cosine": f"1 - {_SUM(f'{_A} * {_B}')} / sqrt({_SUM(f'{_A} ** 2')} * {_SUM(f'{_B} ** 2')})",
    "braycurtis": f"{_SUM(f'abs({_A} - {_B})')} / {_SUM(f'abs({_A} + {_B})')}",
    "minkowski": f"({_SUM(f'abs({_A} - {_B}) ** 4')}) ** 0.25",
}
KINDS = ("cityblock", "chebyshev", "cosine", "canberra")


def kinds_sql(names: tuple[str, ...], k: int) -> str:
    """pr: all pairs under each metric; nn: the k nearest."""
    pairs = " UNION ALL ".join(f"SELECT '{m}' AS metric, a.obj_id, b.obj_id AS nb_id, {DISTANCES[m]} AS dist FROM f a, f b" for m in names)
    return f"{v.FEATURES}, pr AS ({pairs}), nn AS (SELECT * FROM pr WHERE obj_id <> nb_id QUALIFY row_number() OVER (PARTITION BY metric, obj_id ORDER BY dist, nb_id) <= {k})"


LOF_OF_KINDS = LOF.replace("SELECT obj_id, max", "SELECT metric, obj_id, max").replace("GROUP BY 1)", "GROUP BY 1, 2)").replace("SELECT nn.obj_id", "SELECT nn.metric, nn.obj_id").replace("= nn.nb_id", "= nn.nb_id AND KIND.metric = nn.metric").replace("a.obj_id = nn.obj_id", "a.obj_id = nn.obj_id AND a.metric = nn.metric").replace("kd ON kd.obj_id = nn.nb_id AND KIND", "kd ON kd.obj_id = nn.nb_id AND kd").replace("KIND", "b")


@query("g2_lof_metrics", f"WITH {kinds_sql(KINDS, 20)}, {LOF_OF_KINDS} SELECT metric, obj_id, {R('lof', 'lof')} FROM lf")
def g2_metrics(spark, d):
    table = neighbors.scan_neighbours(vectors(spark, d), [20], [(m, None) for m in KINDS])
    return rounded(table.select("metric", "obj_id", "lof"), "lof")


@query("g2_contaminated", f"WITH {NN}, {LOF} SELECT obj_id, {R('lof', 'lof')} FROM lf WHERE lf.lof >= (SELECT quantile_cont(lof, 0.95) FROM lf)")
def g2_cut(spark, d):
    return rounded(neighbors.contaminated(neighbors.local_outlier_factor(vectors(spark, d)), 0.05), "lof")


@query("g3_lof_by_feature", f"""WITH {v.LONG}, s AS (SELECT * FROM fl), nn AS (SELECT a.dim, a.obj_id, b.obj_id AS nb_id, abs(a.x - b.x) AS dist FROM s a JOIN s b ON a.dim = b.dim AND a.obj_id <> b.obj_id QUALIFY row_number() OVER (PARTITION BY a.dim, a.obj_id ORDER BY dist, b.obj_id) <= 20),
 kd AS (SELECT dim, obj_id, max(dist) AS kdist FROM nn GROUP BY 1, 2), lr AS (SELECT nn.dim, nn.obj_id, 1 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM nn JOIN kd ON kd.obj_id = nn.nb_id AND kd.dim = nn.dim GROUP BY 1, 2)
 SELECT nn.dim, nn.obj_id, {R('avg(b.lrd) / any_value(a.lrd)', 'lof')} FROM nn JOIN lr b ON b.obj_id = nn.nb_id AND b.dim = nn.dim JOIN lr a ON a.obj_id = nn.obj_id AND a.dim = nn.dim GROUP BY 1, 2""")
def g3(spark, d):
    return rounded(neighbors.lof_by_feature(vectors(spark, d)), "lof")


@query("g4_random_pick", f"WITH {v.FEATURES} SELECT obj_id FROM f ORDER BY md5(concat(obj_id, ':', 3)), obj_id LIMIT 12")
def g4(spark, d):
    return neighbors.pick(vectors(spark, d).withColumn("lof", F.lit(0.0)), 12, "random", 3).select("obj_id")


@query("g5_labelled_scores", f"WITH {NN}, {LOF} SELECT obj_id, label, {R('lof', 'lof')} FROM lf JOIN f USING (obj_id)")
def g5(spark, d):
    return rounded(neighbors.labelled_scores(neighbors.local_outlier_factor(vectors(spark, d)), names(spark, d)), "lof")


def lof_sql(k: int) -> str:
    """LOF of k neighbours, as setting k, for each metric."""
    near = f"(SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY metric, obj_id ORDER BY dist, nb_id) <= {k})"
    reach = f"(SELECT n.metric, n.obj_id, 1 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM {near} n JOIN (SELECT metric, obj_id, max(dist) AS kdist FROM {near} GROUP BY 1, 2) k ON k.obj_id = n.nb_id AND k.metric = n.metric GROUP BY 1, 2)"
    return f"SELECT {k} AS setting, n.metric, n.obj_id, avg(b.lrd) / any_value(a.lrd) AS lof FROM {near} n JOIN {reach} b ON b.obj_id = n.nb_id AND b.metric = n.metric JOIN {reach} a ON a.obj_id = n.obj_id AND a.metric = n.metric GROUP BY n.metric, n.obj_id"


@query("g6_rare_classes", f"WITH {kinds_sql(('euclidean', 'minkowski', 'braycurtis'), 20)}, s AS ({' UNION ALL '.join(map(lof_sql, (5, 10, 20)))}) SELECT CAST(setting AS INTEGER) AS setting, CASE metric WHEN 'braycurtis' THEN metric ELSE 'minkowski' END AS metric, CASE metric WHEN 'euclidean' THEN 2.0 WHEN 'minkowski' THEN 4.0 END AS p, label, round(avg(lof), 6) + 0.0 AS mean_lof FROM s JOIN f USING (obj_id) WHERE label IN ('1', '7') GROUP BY 1, 2, 3, 4")
def g6(spark, d):
    table = neighbors.scan_neighbours(vectors(spark, d), [5, 10, 20], [("minkowski", 2.0), ("minkowski", 4.0), ("braycurtis", None)])
    return rounded(neighbors.rare_class_scores(table, names(spark, d), ["1", "7"]), "mean_lof")


@query("g7_nearest_to", f"WITH {v.FEATURES} SELECT b.obj_id, round({SQ}, 6) + 0.0 AS sq_dist FROM f a, f b WHERE a.obj_id = 3 AND b.obj_id <> 3 AND a.label = b.label ORDER BY {SQ}, b.obj_id LIMIT 10")
def g7(spark, d):
    return rounded(neighbors.nearest_to(vectors(spark, d), 3, 10, by_label(spark, d)), "sq_dist")


@query("h1_k_means")
def h1(spark, d):
    return cluster.k_means(vectors(spark, d), 10)


def lloyd_sql(steps: int, k: int) -> str:
    out = [f"{v.LONG}", f"m0 AS (SELECT obj_id AS cluster, dim, x AS c FROM fl WHERE obj_id < {k})"]
    for s in range(steps + 1):
        out.append(f"d{s} AS (SELECT obj_id, cluster, sum((x - c) ** 2) AS d FROM fl JOIN m{s} USING (dim) GROUP BY 1, 2), a{s} AS (SELECT obj_id, cluster FROM d{s} QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY d, cluster) = 1)")
        if s < steps:
            out.append(f"m{s + 1} AS (SELECT cluster, dim, avg(x) AS c FROM fl JOIN a{s} USING (obj_id) GROUP BY 1, 2)")
    return ", ".join(out)


@query("h1_lloyd", f"WITH {lloyd_sql(3, 4)} SELECT obj_id, CAST(cluster AS INTEGER) AS cluster FROM a3")
def h1_lloyd(spark, d):
    table = vectors(spark, d)
    start = [r.features for r in table.filter("obj_id < 4").orderBy("obj_id").collect()]
    return cluster.lloyd(table, start, 3)


def em_sql(steps: int, k: int) -> str:
    """Steps on two dimensions from the first k objects, equal weights and round covariances: g0, g1, ... of (c, w, m1, m2, s11, s12, s22)."""
    out = [f"{v.FEATURES}, x AS (SELECT obj_id, features[1] AS x, features[2] AS y FROM f), g0 AS (SELECT obj_id AS c, 1 / {k} AS w, x AS m1, y AS m2, 0.02 AS s11, 0.0 AS s12, 0.02 AS s22 FROM x WHERE obj_id < {k})"]
    for s in range(steps):
        out.append(f"""d{s} AS (SELECT obj_id, x, y, c, w / (2 * pi() * sqrt(s11 * s22 - s12 * s12)) * exp(-0.5 * (s22 * (x - m1) ** 2 - 2 * s12 * (x - m1) * (y - m2) + s11 * (y - m2) ** 2) / (s11 * s22 - s12 * s12)) AS p FROM x, g{s}),
 r{s} AS (SELECT *, p / sum(p) OVER (PARTITION BY obj_id) AS r FROM d{s}), t{s} AS (SELECT c, sum(r) AS n, sum(r * x) / sum(r) AS m1, sum(r * y) / sum(r) AS m2 FROM r{s} GROUP BY 1),
 g{s + 1} AS (SELECT c, any_value(n) / (SELECT count(*) FROM x) AS w, any_value(m1) AS m1, any_value(m2) AS m2, sum(r * (x - m1) ** 2) / any_value(n) + 1e-6 AS s11, sum(r * (x - m1) * (y - m2)) / any_value(n) AS s12, sum(r * (y - m2) ** 2) / any_value(n) + 1e-6 AS s22 FROM r{s} JOIN t{s} USING (c) GROUP BY 1)""")
    return ", ".join(out)


@query("h2_steps", f"WITH {em_sql(3, 3)} SELECT CAST(c AS INTEGER) AS component, {R('w', 'weight')}, {R('m1', 'm1')}, {R('m2', 'm2')}, {R('s11', 's11')}, {R('s12', 's12')}, {R('s22', 's22')} FROM g3")
def h2_steps(spark, d):
    table = stored(vectors(spark, d).select("obj_id", F.slice("features", 1, 2).alias("features")), "vectors")
    means = np.array([r.features for r in table.filter("obj_id < 3").orderBy("obj_id").collect()])
    model = mixture.Mixture(np.full(3, 1 / 3), means, np.tile(0.02 * np.eye(2), (3, 1, 1)))
    for _ in range(3):
        model, _ = mixture.step(table, model, means.mean(0))
    rows = [(c, float(model.weights[c]), *map(float, model.means[c]), *map(float, model.covariances[c][[0, 0, 1], [0, 1, 1]])) for c in range(3)]
    return rounded(spark.createDataFrame(rows, "component int, weight double, m1 double, m2 double, s11 double, s12 double, s22 double"), "weight", "m1", "m2", "s11", "s12", "s22")


@query("h2_gaussian_mixture")
def h2(spark, d):
    return cluster.gaussian_mixture(represent.pca(vectors(spark, d), 4), 5)


EPS, LEAST = 0.85, 4


def dbscan_sql(pairs: str, eps: float, least: int) -> str:
    """lb: the clusters of pairs (obj_id, nb_id, dist) that stand in the table named."""
    return f"""ep AS (SELECT * FROM {pairs} WHERE dist <= {eps}), co AS (SELECT obj_id FROM ep GROUP BY 1 HAVING count(*) >= {least}),
 cl AS (SELECT obj_id AS a, nb_id AS b FROM ep WHERE obj_id IN (FROM co) AND nb_id IN (FROM co)),
 re AS (SELECT a, b FROM cl UNION SELECT re.a, cl.b FROM re JOIN cl ON re.b = cl.a), ro AS (SELECT a AS obj_id, min(b) AS root FROM re GROUP BY 1),
 nr AS (SELECT obj_id, CAST(dense_rank() OVER (ORDER BY root) - 1 AS INTEGER) AS cluster FROM ro),
 bo AS (SELECT ep.obj_id, min(cluster) AS near FROM ep JOIN nr ON nr.obj_id = ep.nb_id GROUP BY 1),
 lb AS (SELECT f.obj_id, coalesce(nr.cluster, near, -1) AS cluster FROM f LEFT JOIN nr USING (obj_id) LEFT JOIN bo USING (obj_id))"""


@query("h3_dbscan", f"WITH RECURSIVE {PAIRS}, {dbscan_sql('pr', EPS, LEAST)} FROM lb")
def h3(spark, d):
    return cluster.dbscan(vectors(spark, d), EPS, LEAST)


#: Radii and numbers of the runs of DBSCAN under other metrics.
RUNS = (("cityblock", 6.9, 3), ("cosine", 0.6, 3), ("braycurtis", 0.62, 3))


@query("h3_dbscan_metrics", " UNION ALL ".join(f"SELECT '{m}' AS metric, * FROM (WITH RECURSIVE {v.FEATURES}, pr AS (SELECT a.obj_id, b.obj_id AS nb_id, CASE WHEN a.obj_id = b.obj_id THEN 0 ELSE {DISTANCES[m]} END AS dist FROM f a, f b), {dbscan_sql('pr', eps, least)} FROM lb)" for m, eps, least in RUNS))
def h3_metrics(spark, d):
    out = None
    for m, eps, least in RUNS:
        own = cluster.dbscan(vectors(spark, d), eps, least, metric=m).select(F.lit(m).alias("metric"), "obj_id", "cluster")
        out = own if out is None else out.unionByName(own)
    return out


NEAREST = 5
REACH = f"{PAIRS}, cd AS (SELECT obj_id, max(dist) AS core FROM (SELECT * FROM pr WHERE obj_id <> nb_id QUALIFY row_number() OVER (PARTITION BY obj_id ORDER BY dist, nb_id) <= {NEAREST}) GROUP BY 1)"


@query("h3_core_distances", f"WITH {REACH} SELECT obj_id, {R('core', 'core')} FROM cd")
def h3_core(spark, d):
    return rounded(hierarchy.core_distances(neighbors.nearest(vectors(spark, d), NEAREST), NEAREST), "core")


# Prim's way: the object nearest to the tree joins it, and the others learn how far they are from it.
@query("h3_tree_weight", f"""WITH RECURSIVE {REACH}, mr AS MATERIALIZED (SELECT pr.obj_id, nb_id, greatest(dist, a.core, b.core) AS w FROM pr JOIN cd a ON a.obj_id = pr.obj_id JOIN cd b ON b.obj_id = nb_id WHERE pr.obj_id <> nb_id),
 t AS (SELECT 0 AS step, nb_id AS id, w AS far FROM mr WHERE obj_id = (SELECT min(obj_id) FROM f)
  UNION ALL SELECT step + 1, id, least(far, w) FROM (SELECT step, id, far, arg_min(id, far) OVER () AS joins FROM t) x JOIN mr ON mr.obj_id = x.joins AND mr.nb_id = x.id WHERE id <> joins)
 SELECT count(*) AS edges, round(sum(far), 6) + 0.0 AS weight FROM (SELECT step, min(far) AS far FROM t GROUP BY 1)""")
def h3_tree(spark, d):
    tree = hierarchy.spanning_tree(*hierarchy.reachability_cells(vectors(spark, d), NEAREST))
    return rounded(tree.agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")), "weight")


@query("h3_hdbscan")
def h3_hdbscan(spark, d):
    return hierarchy.hdbscan(represent.pca(vectors(spark, d), 3), 10, 5)


CL = "c AS (SELECT obj_id, CAST(label AS INTEGER) AS cluster FROM f)"


@query("h4_silhouette", f"""WITH {PAIRS}, {CL}, t AS (SELECT pr.obj_id, a.cluster, b.cluster AS other, sum(dist) AS total, count(*) AS n FROM pr JOIN c a ON a.obj_id = pr.obj_id JOIN c b ON b.obj_id = pr.nb_id GROUP BY 1, 2, 3),
 s AS (SELECT obj_id, max(CASE WHEN cluster = other AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN cluster <> other THEN total / n END) AS b FROM t GROUP BY 1) SELECT obj_id, {R('(b - a) / greatest(a, b)', 'silhouette')} FROM s""")
def h4(spark, d):
    return rounded(cluster.silhouette(vectors(spark, d), by_label(spark, d)), "silhouette")


CENTRES = "ce AS (SELECT cluster, dim, avg(x) AS c, median(x) AS md FROM fl JOIN c USING (obj_id) GROUP BY 1, 2)"


@query("h4_separation", f"""WITH {v.LONG}, {CL}, {CENTRES}, di AS (SELECT obj_id, cluster, sum((x - c) ** 2) AS q FROM fl JOIN c USING (obj_id) JOIN ce USING (cluster, dim) GROUP BY 1, 2),
 pe AS (SELECT cluster, count(*) AS n, sum(q) AS w, avg(sqrt(q)) AS s FROM di GROUP BY 1), am AS (SELECT dim, avg(x) AS m FROM fl GROUP BY 1),
 ou AS (SELECT cluster, sum((c - m) ** 2) AS b FROM ce JOIN am USING (dim) GROUP BY 1), ch AS (SELECT (sum(n * b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS v FROM pe JOIN ou USING (cluster)),
 cd AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) ** 2)) AS d FROM ce a JOIN ce b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2),
 db AS (SELECT avg(w) AS v FROM (SELECT i, max((a.s + b.s) / d) AS w FROM cd JOIN pe a ON a.cluster = i JOIN pe b ON b.cluster = j GROUP BY 1)) SELECT {R('ch.v', 'calinski_harabasz')}, {R('db.v', 'davies_bouldin')} FROM ch, db""")
def h4_sep(spark, d):
    return rounded(cluster.separation(vectors(spark, d), by_label(spark, d)), "calinski_harabasz", "davies_bouldin")


@query("h5_mixture_scan")
def h5(spark, d):
    return rounded(cluster.mixture_scan(represent.pca(vectors(spark, d), 3), [2, 3]), "silhouette", "calinski_harabasz", "davies_bouldin", digits=4)


RADII, SAMPLES = (0.85, 1.1, 1.15), (2, 4)


@query("h5_dbscan_scan", f"WITH RECURSIVE {PAIRS} SELECT eps, min_samples, CAST(count(DISTINCT cluster) FILTER (cluster >= 0) AS BIGINT) AS clusters, count(*) FILTER (cluster < 0) AS noise FROM (" + " UNION ALL ".join(f"(WITH RECURSIVE {dbscan_sql('pr', e, m)} SELECT CAST({e} AS DOUBLE) AS eps, {m} AS min_samples, cluster FROM lb)" for e in RADII for m in SAMPLES) + ") GROUP BY 1, 2")
def h5_dbscan(spark, d):
    return hierarchy.dbscan_scan(vectors(spark, d), list(RADII), list(SAMPLES))


@query("h5_hdbscan_scan")
def h5_hdbscan(spark, d):
    return hierarchy.hdbscan_scan(represent.pca(vectors(spark, d), 3), [5, 15], [5])


DIST = f"{v.LONG}, {CL}, {CENTRES}, di AS (SELECT obj_id, cluster, sum((x - md) ** 2) AS sq_dist FROM fl JOIN c USING (obj_id) JOIN ce USING (cluster, dim) GROUP BY 1, 2)"
CORE = DIST + ", th AS (SELECT cluster, median(sq_dist) + 0.5 * stddev_pop(sq_dist) AS threshold FROM di GROUP BY 1), core AS (SELECT obj_id, cluster, sq_dist, CAST(sq_dist <= threshold AS INTEGER) AS is_core, CAST(sq_dist < threshold AS INTEGER) AS inside FROM di JOIN th USING (cluster))"


def distances(spark, d):
    return cluster.centre_distance(vectors(spark, d), by_label(spark, d))


@query("h6_centre_distance", f"WITH {DIST} SELECT obj_id, cluster, {R('sq_dist', 'sq_dist')} FROM di")
def h6(spark, d):
    return rounded(distances(spark, d), "sq_dist")


@query("h6_density_centre", f"""WITH {v.FEATURES}, p AS (SELECT obj_id, CAST(label AS INTEGER) AS cluster, features[1] AS x, features[2] AS y FROM f),
 s AS (SELECT cluster, var_samp(x) * count(*) ** (-1.0 / 3) AS xx, covar_samp(x, y) * count(*) ** (-1.0 / 3) AS xy, var_samp(y) * count(*) ** (-1.0 / 3) AS yy FROM p GROUP BY 1),
 e AS (SELECT a.cluster, a.obj_id, sum(exp(-0.5 * (yy * (a.x - b.x) ** 2 - 2 * xy * (a.x - b.x) * (a.y - b.y) + xx * (a.y - b.y) ** 2) / (xx * yy - xy * xy))) AS density FROM p a JOIN p b USING (cluster) JOIN s USING (cluster) GROUP BY 1, 2)
 SELECT cluster, obj_id FROM e QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(density, 9) DESC, obj_id) = 1""")
def h6_density(spark, d):
    table = vectors(spark, d).select("obj_id", F.slice("features", 1, 2).alias("features"))
    return cluster.densest_member(table, by_label(spark, d)).select("cluster", "obj_id")


@query("h7_core_members", f"WITH {CORE} SELECT obj_id, cluster, is_core FROM core")
def h7(spark, d):
    return cluster.core_members(distances(spark, d), 0.5).select("obj_id", "cluster", "is_core")


@query("h8_central_member", f"WITH {DIST} SELECT cluster, arg_min(obj_id, sq_dist) AS obj_id FROM di GROUP BY 1")
def h8(spark, d):
    return cluster.central_member(distances(spark, d)).select("cluster", "obj_id")


MATCHED = f"""{v.MIXED_SQL}, {CORE.replace(CL, "c AS (SELECT id AS obj_id, pred_label AS cluster FROM mx)")}, ct AS (SELECT cluster AS l, true_label AS r, count(*) AS n FROM core JOIN mx ON id = obj_id WHERE is_core = 1 GROUP BY 1, 2), {v.best_match_sql('ct')}"""


@query("h9_name_by_match", f"WITH {MATCHED} SELECT obj_id, cluster, CASE WHEN is_core = 1 THEN CAST(([p0, p1, p2, p3, p4])[cluster + 1] AS VARCHAR) ELSE 'UNCLASSIFIED' END AS name FROM core, best")
def h9(spark, d):
    mixed = v.mixed_labels(spark, d)
    clusters = mixed.select(F.col("id").alias("obj_id"), F.col("pred_label").alias("cluster"))
    core = cluster.core_members(cluster.centre_distance(vectors(spark, d), clusters), 0.5)
    return cluster.name_by_match(core, mixed.select(F.col("id").alias("obj_id"), F.col("true_label").alias("label")))


MIXED = "nm AS (SELECT obj_id, CASE WHEN obj_id % 3 = 0 THEN '0' ELSE label END AS label FROM f)"


@query("h10_name_by_majority", f"""WITH {CORE}, {MIXED}, ct AS (SELECT cluster, label, count(*) FILTER (inside = 1) AS n FROM core JOIN nm USING (obj_id) GROUP BY 1, 2),
 rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS k, coalesce(lead(n) OVER (PARTITION BY cluster ORDER BY n DESC, label), 0) AS second, stddev_pop(n) OVER (PARTITION BY cluster) AS s FROM ct),
 wo AS (SELECT cluster, label AS name FROM rk WHERE k = 1 AND n > second + s) SELECT obj_id, core.cluster, coalesce(CASE WHEN inside = 1 THEN name END, 'UNCLASSIFIED') AS name FROM core LEFT JOIN wo ON wo.cluster = core.cluster""")
def h10(spark, d):
    mixed = names(spark, d).withColumn("label", F.when(F.col("obj_id") % 3 == 0, "0").otherwise(F.col("label")))
    return cluster.name_by_majority(cluster.core_members(distances(spark, d), 0.5), mixed, 1.0)


@query("h11_sizes", f"WITH {v.FEATURES}, {CL} SELECT cluster, count(*) AS n FROM c GROUP BY 1")
def h11(spark, d):
    return cluster.sizes(by_label(spark, d))


@query("h11_distance_histogram", f"WITH {DIST}, e AS (SELECT min(sq_dist) AS a, max(sq_dist) AS b FROM di) SELECT cluster, CAST(least(floor((sq_dist - a) / ((b - a) / 10)), 9) AS INTEGER) AS bin, count(*) AS n FROM di, e GROUP BY 1, 2")
def h11_hist(spark, d):
    return features.histogram(distances(spark, d), "sq_dist", 10, ["cluster"])


@query("h12_two_pass")
def h12(spark, d):
    table = stored(represent.pca(vectors(spark, d), 3), "projected")
    parts = represent.split_by_error(half_errors(spark, d)).select("obj_id", "part")
    return cluster.two_pass(table, parts, names(spark, d), 3, 0.5)
