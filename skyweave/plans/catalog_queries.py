"""Queries on catalogs, labels and their evaluation."""

from pyspark.sql import functions as F

from ..operators import catalog, evaluate, features
from . import views as v
from .registry import Registry, rounded

REGISTRY = query = Registry()
R = lambda x, name: f"round({x}, 6) + 0.0 AS {name}"
#: Fixed label tables of the queries.
UNWANTED = ["X", "PM"]
RENAME = {"E": "EB", "SRA": "SR"}
PARENTS = {"EA": "EB", "RRAB": "RR", "DSCTC": "DSCT"}
FAMILY = {"EA": "eclipsing", "E": "eclipsing", "RRAB": "pulsating", "DSCTC": "pulsating", "CEP": "pulsating", "M": "pulsating", "SRA": "pulsating"}
SEP = "2 * degrees(asin(least(1, sqrt(sin(radians(s.dec - c.dec) / 2) ** 2 + cos(radians(c.dec)) * cos(radians(s.dec)) * sin(radians(s.ra - c.ra) / 2) ** 2))))"


def sql_map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{x}'" for k, x in pairs.items()) + "}"


def sql_list(x: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '\\([^)]*\\)', '', 'g'), '[+/]', '|', 'g'), '|'), lambda y: regexp_replace(trim(y), '[:?*]+$', '')), lambda y: y <> '')"


#: Parsed labels, sorted and distinct; unwanted ones dropped.
PARSED = v.TYPES + f", pa AS (SELECT id, list_sort(list_distinct(list_filter({sql_list('otype')}, lambda y: y NOT IN ('X', 'PM')))) AS l FROM types)"


def parsed(spark, d):
    return v.raw_types(spark, d).select("id", catalog.parse_labels(F.col("otype"), {}, UNWANTED).alias("l"))


def parsed_text(spark, d):
    return parsed(spark, d).select("id", F.array_join("l", "|").alias("otype"))


PT = PARSED + ", pt AS (SELECT id, array_to_string(l, '|') AS otype FROM pa)"


@query("i1_keep_targets", f"WITH {v.CATALOG} SELECT ID, sector, ra FROM catalog WHERE ID % 5 = 0")
def i1(spark, d):
    c = v.catalog(spark, d)
    return catalog.keep_targets(c.drop("sector"), c.filter("ID % 5 = 0")).select("ID", "sector", "ra")


@query("i2_coverage", f"WITH {v.CATALOG} SELECT sector, count(*) AS targets, count(CASE WHEN ID % 3 = 0 THEN 1 END) AS found FROM catalog GROUP BY 1")
def i2(spark, d):
    c = v.catalog(spark, d)
    return catalog.coverage(c, c.filter("ID % 3 = 0"))


@query("i3_without_series", f"WITH {v.LC} SELECT c_custkey AS obj_id FROM customer WHERE c_custkey NOT IN (SELECT obj_id FROM lc)")
def i3(spark, d):
    return catalog.without_series(v.catalog(spark, d).select(F.col("ID").alias("obj_id")), v.lc(spark, d))


NEAR = v.SOURCES + f", near AS (SELECT c.ID, source_id, sep * 3600 AS sep_arcsec FROM (SELECT c.ID, s.source_id, {SEP} AS sep FROM catalog c JOIN sources s ON abs(c.dec - s.dec) < 0.003) c WHERE sep * 3600 < 10 QUALIFY row_number() OVER (PARTITION BY ID ORDER BY sep, source_id) = 1)"


def matched(spark, d):
    return catalog.sky_match(v.catalog(spark, d), v.sources(spark, d), 10.0)


@query("i4_sky_match", f"WITH {NEAR} SELECT catalog.ID, source_id, {R('sep_arcsec', 'sep_arcsec')} FROM catalog LEFT JOIN near USING (ID)")
def i4(spark, d):
    return rounded(matched(spark, d), "sep_arcsec")


@query("i5_match_counts", f"WITH {NEAR} " + " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS tol, count(CASE WHEN sep_arcsec < {t} THEN 1 END) AS n FROM near" for t in (0.1, 1.0, 10.0)))
def i5(spark, d):
    return catalog.match_counts(matched(spark, d), [0.1, 1.0, 10.0])


@query("i5_magnitude_pairs", f"WITH {NEAR} SELECT near.ID, near.source_id, {R('Tmag', 'Tmag')}, {R('magMax', 'magMax')} FROM near JOIN catalog USING (ID) JOIN sources s ON s.source_id = near.source_id")
def i5_pairs(spark, d):
    return rounded(catalog.magnitude_pairs(matched(spark, d), v.catalog(spark, d), v.sources(spark, d)), "Tmag", "magMax")


@query("i6_id_match", f"WITH {v.CATALOG} SELECT ID, s_name AS name FROM catalog LEFT JOIN supplier ON s_suppkey = ID")
def i6(spark, d):
    other = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ID"), F.col("s_name").alias("name"))
    return catalog.id_match(v.catalog(spark, d).select("ID"), other)


@query("i7_first_alternate", """WITH k AS (SELECT 'A' || s_suppkey AS alt_id, s_name AS main_id FROM supplier), r AS (SELECT c_custkey AS ID, unnest([0, 1, 2]) AS priority, unnest(['A' || (c_custkey + 90), NULL, 'A' || (c_custkey // 2)]) AS alt_id FROM customer),
 b AS (SELECT ID, main_id, priority FROM r JOIN k USING (alt_id) QUALIFY row_number() OVER (PARTITION BY ID ORDER BY priority, main_id) = 1) SELECT c_custkey AS ID, main_id, b.priority FROM customer LEFT JOIN b ON b.ID = c_custkey""")
def i7(spark, d):
    t = v.catalog(spark, d).select("ID", F.concat(F.lit("A"), F.col("ID") + 90).alias("a"), F.lit(None).cast("string").alias("b"), F.concat(F.lit("A"), F.floor(F.col("ID") / 2)).alias("c"))
    known = v.table(spark, d, "supplier").select(F.concat(F.lit("A"), "s_suppkey").alias("alt_id"), F.col("s_name").alias("main_id"))
    return catalog.first_alternate(t, ["a", "b", "c"], known)


@query("i8_cone", f"WITH {v.CATALOG}, p AS (SELECT 180.0 AS ra, 10.0 AS dec) SELECT ID, {R('sep', 'sep')} FROM (SELECT c.ID, {SEP} AS sep FROM catalog c, p s WHERE Tmag < 8) WHERE sep <= 15")
def i8(spark, d):
    return rounded(catalog.cone(v.catalog(spark, d), 180.0, 10.0, 15.0, 8.0).select("ID", "sep"), "sep")


@query("i9_sexagesimal", f"SELECT s_suppkey AS ID, {R('(s_suppkey % 24 + 30 / 60.0 + 15.5 / 3600) * 15', 'ra')}, {R('-(s_suppkey % 80 + 12 / 60.0 + 6 / 3600.0)', 'dec')} FROM supplier")
def i9(spark, d):
    s = v.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ID"), F.concat(F.col("s_suppkey") % 24, F.lit(" 30 15.5")).alias("a"), F.concat(F.lit("-"), F.col("s_suppkey") % 80, F.lit(":12:06")).alias("b"))
    return rounded(s.select("ID", catalog.sexagesimal(F.col("a"), True).alias("ra"), catalog.sexagesimal(F.col("b"), False).alias("dec")), "ra", "dec")


@query("i10_parse_labels", f"WITH {v.TYPES} SELECT id, array_to_string(list_sort(list_distinct(list_filter(list_transform({sql_list('otype')}, lambda y: coalesce({sql_map(RENAME)}[y], y)), lambda y: y NOT IN ('X', 'PM')))), '|') AS otype FROM types")
def i10(spark, d):
    return v.raw_types(spark, d).select("id", F.array_join(catalog.parse_labels(F.col("otype"), RENAME, UNWANTED), "|").alias("otype"))


@query("i11_rename_labels", f"WITH {PT} SELECT id, array_to_string(list_transform(string_split(otype, '|'), lambda y: coalesce({sql_map(RENAME)}[y], y)), '|') AS otype FROM pt")
def i11(spark, d):
    return parsed_text(spark, d).select("id", catalog.rename_labels(F.col("otype"), RENAME).alias("otype"))


@query("i12_to_parents", f"WITH {PARSED} SELECT id, CASE WHEN len(l) = 0 THEN 'NONE' ELSE array_to_string(list_sort(list_distinct(list_transform(l, lambda y: coalesce({sql_map(PARENTS)}[y], y)))), '|') END AS otype FROM pa")
def i12(spark, d):
    return parsed(spark, d).select("id", F.array_join(catalog.to_parents(F.col("l"), PARENTS), "|").alias("otype"))


@query("i13_merge_labels", f"WITH {PARSED}, m AS (SELECT id, list_distinct(list_transform(l, lambda y: coalesce({sql_map({'LB': 'L'})}[y], y))) AS l FROM pa) SELECT id, array_to_string(list_sort(CASE WHEN list_contains(l, 'EA') THEN list_filter(l, lambda y: y NOT IN ('E', 'DM')) ELSE l END), '|') AS otype FROM m")
def i13(spark, d):
    return parsed(spark, d).select("id", F.array_join(catalog.merge_labels(F.col("l"), {"LB": "L"}, {"EA": ["E", "DM"]}), "|").alias("otype"))


@query("i14_truth", f"WITH {v.TYPES} SELECT id, CASE WHEN id % 4 = 0 THEN 'C' WHEN id % 2 = 0 THEN 'B' ELSE otype END AS otype FROM types")
def i14(spark, d):
    t = v.raw_types(spark, d)
    return catalog.truth_of([t, t.filter("id % 2 = 0").withColumn("otype", F.lit("B")), t.filter("id % 4 = 0").withColumn("otype", F.lit("C"))])


@query("i15_merge_rows", f"WITH {PT}, e AS (SELECT id % 100 AS id, unnest(string_split(otype, '|')) AS l FROM pt), o AS (SELECT DISTINCT id % 100 AS id FROM pt), g AS (SELECT id, list_sort(list_distinct(list(l))) AS l FROM e WHERE l NOT IN ('', 'M') GROUP BY 1) SELECT o.id, coalesce(array_to_string(l, '|'), '') AS otype FROM o LEFT JOIN g USING (id)")
def i15(spark, d):
    return catalog.merge_rows(parsed_text(spark, d).withColumn("id", F.col("id") % 100), ["M"])


@query("i16_truth_lookup", f"WITH {v.TYPES} SELECT p_partkey AS id, CASE WHEN t.id IS NULL THEN '' WHEN trim(otype) = '' THEN 'NONE' ELSE otype END AS otype FROM part LEFT JOIN (SELECT * FROM types WHERE id % 3 = 0) t ON t.id = p_partkey")
def i16(spark, d):
    t = v.raw_types(spark, d)
    return catalog.truth_lookup(t, t.filter("id % 3 = 0").withColumn("priority", F.lit(0)))


@query("i17_override", f"WITH {PT} SELECT id, CASE WHEN id % 50 = 0 THEN 'SPECIAL' ELSE array_to_string(list_filter(string_split(otype, '|'), lambda y: y <> 'Pec'), '|') END AS otype FROM pt")
def i17(spark, d):
    t = parsed_text(spark, d)
    return catalog.override(t, t.filter("id % 50 = 0").select("id", F.lit("SPECIAL").alias("special")))


@query("i18_number_labels", f"WITH {PT} SELECT id, otype, CAST(dense_rank() OVER (ORDER BY otype) - 1 AS INTEGER) AS number FROM pt")
def i18(spark, d):
    return catalog.number_labels(parsed_text(spark, d))


@query("i19_having_class", f"WITH {PT} SELECT id FROM pt WHERE contains(otype, 'EA')")
def i19(spark, d):
    return catalog.having_class(parsed_text(spark, d), "EA").select("id")


@query("i20_clean_labels", f"WITH {v.TYPES}, c AS (SELECT id, list_filter(list_transform(regexp_split_to_array(otype, '[|+/]'), lambda y: regexp_replace(regexp_replace(y, '\\s', '', 'g'), '[:?*]+$', '')), lambda y: y NOT IN ('', 'X')) AS l FROM types) SELECT id, array_to_string(l, '|') AS otype FROM c WHERE len(l) > 0")
def i20(spark, d):
    return catalog.clean_labels(v.raw_types(spark, d), ["X"])


FAM = PT + f", fa AS (SELECT unnest({list(FAMILY)!r}) AS type, unnest({list(FAMILY.values())!r}) AS family), ex AS (SELECT id, otype, unnest(string_split(otype, '|')) AS type FROM pt), hi AS (SELECT DISTINCT id, family FROM ex JOIN fa USING (type)), fm AS (SELECT * FROM hi UNION ALL SELECT id, CASE WHEN otype IN ('', 'NONE') THEN 'not classified' ELSE 'other' END FROM pt WHERE id NOT IN (SELECT id FROM hi))"


def family_table(spark):
    return spark.createDataFrame(list(FAMILY.items()), "type string, family string")


@query("i21_families", f"WITH {FAM} SELECT id, family FROM fm")
def i21(spark, d):
    return catalog.families(parsed_text(spark, d), family_table(spark))


@query("i21_family_counts", f"WITH {FAM} SELECT family, count(DISTINCT id) AS objects FROM fm GROUP BY 1")
def i21_counts(spark, d):
    return catalog.family_counts(parsed_text(spark, d), family_table(spark))


@query("i22_budget", f"WITH {PT}, c AS (SELECT otype, count(*) AS n FROM pt GROUP BY 1) SELECT otype, n, 'label ' || otype AS description, CASE WHEN row_number() OVER (ORDER BY n DESC, otype) <= 5 THEN otype ELSE 'rest' END AS \"group\" FROM c")
def i22(spark, d):
    labels = parsed_text(spark, d)
    return catalog.budget(labels, labels.select("otype", F.concat(F.lit("label "), "otype").alias("description")).distinct())


@query("i23_together", f"WITH {v.TYPES} SELECT id, otype, CAST(id % 2 AS INTEGER) AS sector FROM types")
def i23(spark, d):
    t = v.raw_types(spark, d)
    return catalog.together([t.filter(f"id % 2 = {s}").withColumn("sector", F.lit(s)) for s in (0, 1)])


def matrix(spark, d):
    return evaluate.confusion(v.pred_labels(spark, d), v.true_labels(spark, d))


@query("j1_confusion", f"WITH {v.MATRIX} SELECT true_label, pred_label, n FROM cm")
def j1(spark, d):
    return matrix(spark, d)


@query("j2_best_order", f"""WITH {v.MIXED_SQL}, ct AS (SELECT true_label AS l, pred_label AS r, count(*) AS n FROM mx GROUP BY 1, 2), {v.best_match_sql('ct')}
 SELECT CAST(k AS INTEGER) AS true_label, CAST(([p0, p1, p2, p3, p4])[k + 1] AS INTEGER) AS pred_label, {R('hit / (SELECT count(*) FROM mx)', 'accuracy')} FROM best, range(5) t(k)""")
def j2(spark, d):
    rows = v.mixed_labels(spark, d)
    match, accuracy = evaluate.best_order(evaluate.confusion(rows.select("id", F.col("pred_label").alias("label")), rows.select("id", F.col("true_label").alias("label"))))
    return rounded(spark.createDataFrame([(int(a), int(b), accuracy) for a, b in match.items()], "true_label int, pred_label int, accuracy double"), "accuracy")


SCORES = v.MATRIX + """, tr AS (SELECT true_label AS label, sum(n) AS n_true, sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1), pc AS (SELECT pred_label AS label, sum(n) AS n_pred FROM cm GROUP BY 1), tt AS (SELECT sum(n) AS total FROM cm),
 sc AS (SELECT label, tp / nullif(n_true, 0) AS recall, (n_pred - tp) / nullif(n_pred, 0) AS false_discovery, tp / nullif(n_pred, 0) AS precision, (total - (n_pred - tp) - (n_true - tp)) / total AS accuracy, CAST(n_true AS BIGINT) AS n_true, CAST(n_pred AS BIGINT) AS n_pred FROM tr JOIN pc USING (label), tt)"""
FOUR = ("recall", "false_discovery", "precision", "accuracy")


@query("j3_class_scores", f"WITH {SCORES} SELECT label, {', '.join(R(c, c) for c in FOUR)}, n_true, n_pred FROM sc")
def j3(spark, d):
    return rounded(evaluate.class_scores(matrix(spark, d)), *FOUR)


@query("j4_summary", f"WITH {SCORES} SELECT label, {', '.join(f'round({c}, 2) AS {c}' for c in FOUR)}, n_true, n_pred FROM sc WHERE label IN (1, 4, 6)")
def j4(spark, d):
    return evaluate.summary(evaluate.class_scores(matrix(spark, d)), [1, 4, 6])


@query("j5_cases", f"""WITH {v.LABELS}, b AS (SELECT id, t.label AS true_label, p.label AS pred_label FROM tl t JOIN pl p USING (id)), k AS (SELECT true_label AS label, 'TP' AS kind, id FROM b WHERE true_label = pred_label UNION ALL SELECT pred_label, 'FP', id FROM b WHERE true_label <> pred_label UNION ALL SELECT true_label, 'FN', id FROM b WHERE true_label <> pred_label)
 SELECT label, kind, id FROM k QUALIFY row_number() OVER (PARTITION BY label, kind ORDER BY id) <= 5""")
def j5(spark, d):
    return evaluate.cases(v.pred_labels(spark, d), v.true_labels(spark, d), 5)


@query("j6_class_means", f"WITH {v.LABELS}, {v.CATALOG}, m AS (SELECT id, label, 'true' AS kind FROM tl UNION ALL SELECT id, label, 'pred' FROM pl) SELECT label, kind, count(*) AS n, {R('avg(Tmag)', 'mean_Tmag')} FROM m JOIN catalog c ON c.ID = m.id GROUP BY 1, 2")
def j6(spark, d):
    c = v.catalog(spark, d).withColumnRenamed("ID", "id")
    return rounded(evaluate.class_means(v.pred_labels(spark, d), v.true_labels(spark, d), c, ["Tmag"]), "mean_Tmag")


@query("j6_class_histogram", f"WITH {v.LABELS}, {v.CATALOG}, m AS (SELECT label, Tmag FROM tl JOIN catalog c ON c.ID = tl.id), e AS (SELECT min(Tmag) AS a, max(Tmag) AS b FROM m) SELECT label, CAST(least(floor((Tmag - a) / ((b - a) / 6)), 5) AS INTEGER) AS bin, count(*) AS n FROM m, e GROUP BY 1, 2")
def j6_hist(spark, d):
    c = v.catalog(spark, d).withColumnRenamed("ID", "id")
    return features.histogram(v.true_labels(spark, d).join(c, "id"), "Tmag", 6, ["label"])


LISTS = {"first": ["EA", "L", "M"], "second": ["E", "LB", "DM"]}


def single_sql(priority: list) -> str:
    return f"SELECT id, arg_min(l, CASE WHEN list_position({priority!r}, l) IS NULL THEN '9' || l ELSE CAST(list_position({priority!r}, l) AS VARCHAR) END) AS label FROM (SELECT id, unnest(string_split(otype, '|')) AS l FROM pt) GROUP BY id"


@query("j7_single_label", f"WITH {PT} {single_sql(LISTS['first'])}")
def j7(spark, d):
    return evaluate.single_label(parsed_text(spark, d), LISTS["first"])


@query("j7_list_accuracy", f"WITH {PT}, " + ", ".join(f"s{i} AS ({single_sql(p)})" for i, p in enumerate(LISTS.values())) + " " + " UNION ALL ".join(f"SELECT '{n}' AS list, round(avg(CAST(s{i}.label = CASE WHEN id % 2 = 0 THEN 'EA' ELSE 'L' END AS INTEGER)), 6) + 0.0 AS accuracy FROM s{i}" for i, n in enumerate(LISTS)))
def j7_accuracy(spark, d):
    rows = parsed_text(spark, d)
    pred = rows.select("id", F.when(F.col("id") % 2 == 0, "EA").otherwise("L").alias("label"))
    return rounded(evaluate.list_accuracy(pred, rows, LISTS), "accuracy")
