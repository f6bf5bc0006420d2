"""Views on the given tables, the same in Spark and in SQL."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import shared_folder, write_series

SECTOR_2 = "2024-01-16"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series from events; flagged where the event is an error."""
    e = table(spark, sf_dir, "events")
    t = F.timestamp_diff("MICROSECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 86400e6
    sector = F.when(F.col("ts") < F.lit(SECTOR_2).cast("timestamp_ntz"), 1).otherwise(2)
    return e.select(F.col("user_id").alias("obj_id"), sector.alias("sector"), t.alias("t"), F.col("value").alias("flux"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("quality"))


LC = f"""lc AS (SELECT user_id AS obj_id, CASE WHEN ts < TIMESTAMP '{SECTOR_2}' THEN 1 ELSE 2 END AS sector,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS t, value AS flux, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS quality FROM events)"""
#: Unmasked samples.
OK = LC + ", ok AS (SELECT * FROM lc WHERE quality = 0)"


def ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc(spark, sf_dir).filter("quality = 0")


def series_table(spark: SparkSession, sf_dir: str, masked: bool = True) -> DataFrame:
    """The series (unmasked samples alone, or all) as a new bucketed table."""
    name = f"series_{uuid.uuid4().hex}"
    return write_series((ok if masked else lc)(spark, sf_dir), name, shared_folder(spark, name))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radius and mass of the star of every customer key; every seventh has none."""
    k = F.col("c_custkey")
    known = lambda x: F.when(k % 7 != 0, x)
    return table(spark, sf_dir, "customer").select(k.alias("obj_id"), known(0.5 + k % 10 / 10).alias("radius"), known(0.6 + k % 8 / 10).alias("mass"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("obj_id")).distinct()
    return e.select("obj_id", (F.col("obj_id") % 4 + 1).cast("int").alias("camera"), (F.floor(F.col("obj_id") / 4) % 4 + 1).cast("int").alias("ccd"))


TARGETS = "targets AS (SELECT DISTINCT user_id AS obj_id, CAST(user_id % 4 + 1 AS INTEGER) AS camera, CAST((user_id // 4) % 4 + 1 AS INTEGER) AS ccd FROM events)"


def grid(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    """Means of unmasked samples on a shared axis of `days` a step; absent cells are NULL."""
    i = F.floor(F.col("t") / days)
    cells = ok(spark, sf_dir).groupBy("obj_id", i.alias("i")).agg(F.avg("flux").alias("flux"))
    axis = lc(spark, sf_dir).select(i.alias("i")).distinct()
    objects = lc(spark, sf_dir).select("obj_id").distinct()
    return objects.crossJoin(F.broadcast(axis)).join(cells, ["obj_id", "i"], "left")  # the axis has a row a step


def grid_sql(days: int) -> str:
    return f"""{OK}, grid AS (SELECT o.obj_id, a.i, c.flux FROM (SELECT DISTINCT obj_id FROM lc) o CROSS JOIN (SELECT DISTINCT CAST(floor(t / {days}) AS BIGINT) AS i FROM lc) a
 LEFT JOIN (SELECT obj_id, CAST(floor(t / {days}) AS BIGINT) AS i, avg(flux) AS flux FROM ok GROUP BY ALL) c ON o.obj_id = c.obj_id AND a.i = c.i)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obj_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").cast("string").alias("label"))


FEATURES = "f AS (SELECT vec_id AS obj_id, CAST(embedding AS DOUBLE[]) AS features, CAST(label AS VARCHAR) AS label FROM embeddings)"
LONG = FEATURES + ", fl AS (SELECT obj_id, label, unnest(range(len(features))) AS dim, unnest(features) AS x FROM f)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("ID"), ((k * 137 % 36000) / 100.0).alias("ra"), ((k * 91 % 18000) / 100.0 - 90).alias("dec"), ((F.col("c_acctbal") + 1000) / 1000).alias("Tmag"), F.col("c_mktsegment").alias("objType"), (k % 2 + 1).cast("int").alias("sector"))


CATALOG = "catalog AS (SELECT c_custkey AS ID, (c_custkey * 137 % 36000) / 100.0 AS ra, (c_custkey * 91 % 18000) / 100.0 - 90 AS dec, (c_acctbal + 1000) / 1000 AS Tmag, c_mktsegment AS objType, CAST(c_custkey % 2 + 1 AS INTEGER) AS sector FROM customer)"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third object of the catalog, its declination shifted by 0.05 to 5 arcseconds."""
    shift = F.element_at(F.array(*map(F.lit, (0.05, 0.5, 5.0))), (F.col("ID") % 9 / 3).cast("int") + 1) / 3600
    return catalog(spark, sf_dir).filter("ID % 3 = 0").select((F.col("ID") + 1_000_000).alias("source_id"), "ra", (F.col("dec") + F.when(F.col("dec") > 0, -shift).otherwise(shift)).alias("dec"), (F.col("Tmag") + 0.5).alias("magMax"))


SOURCES = CATALOG + """, sources AS (SELECT ID + 1000000 AS source_id, ra, dec + CASE WHEN dec > 0 THEN -1 ELSE 1 END * ([0.05, 0.5, 5.0])[CAST(ID % 9 // 3 AS INTEGER) + 1] / 3600 AS dec, Tmag + 0.5 AS magMax FROM catalog WHERE ID % 3 = 0)"""
#: Fixed label strings, in the order of the key's remainder by 12.
RAW_TYPES = ("EA/DM", "E+EA", "RRAB:", "DSCTC(B)", "CEP*", "SRA?", "L+LB", "X", "Pec", "M", "", "PM")


def raw_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, RAW_TYPES)), (F.col("p_partkey") % 12).cast("int") + 1).alias("otype"))


TYPES = f"types AS (SELECT p_partkey AS id, ({list(RAW_TYPES)!r})[CAST(p_partkey % 12 AS INTEGER) + 1] AS otype FROM part)"


def true_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))


def pred_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 10).cast("int").alias("label"))


LABELS = "tl AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label FROM embeddings), pl AS (SELECT vec_id AS id, CAST((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER) AS label FROM embeddings)"
MATRIX = LABELS + """, cells AS (SELECT t.label AS true_label, p.label AS pred_label, count(*) AS n FROM tl t JOIN pl p USING (id) GROUP BY ALL),
 ls AS (SELECT true_label AS l FROM cells UNION SELECT pred_label FROM cells),
 cm AS (SELECT a.l AS true_label, b.l AS pred_label, coalesce(n, 0) AS n FROM ls a CROSS JOIN ls b LEFT JOIN cells c ON c.true_label = a.l AND c.pred_label = b.l)"""


#: Predictions of five classes, by true class and last digit of vec_id / 10: their best one-to-one match is 0-1, 1-3, 2-0,
#: 3-2, 4-4, where taking the largest count first gives 0-3 and leaves 1 without a match.
MIXED = ("3333331111", "3333302244", "0000000444", "2222222211", "4444444441")


def mixed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, true_label, pred_label) of five classes that a match must reorder."""
    true = (F.col("label") % 5).cast("int")
    row = F.element_at(F.array(*map(F.lit, MIXED)), true + 1)
    pred = F.substring(row, (F.floor(F.col("vec_id") / 10) % 10 + 1).cast("int"), F.lit(1)).cast("int")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), true.alias("true_label"), pred.alias("pred_label"))


MIXED_SQL = f"mx AS (SELECT vec_id AS id, CAST(label % 5 AS INTEGER) AS true_label, CAST(substr(({list(MIXED)!r})[CAST(label % 5 AS INTEGER) + 1], CAST(vec_id // 10 % 10 AS INTEGER) + 1, 1) AS INTEGER) AS pred_label FROM embeddings)"


def best_match_sql(counts: str, n: int = 5) -> str:
    """`best`: one row of p0, p1, ...: the right side of each left one; all orders are tried. counts: (l, r, n)."""
    sides = ", ".join(f"range({n}) r{k}(p{k})" for k in range(n))
    apart = " AND ".join(f"p{i} <> p{j}" for i in range(n) for j in range(i))
    total = " + ".join(f"coalesce((SELECT n FROM {counts} WHERE l = {k} AND r = p{k}), 0)" for k in range(n))
    return f"best AS (SELECT *, {total} AS hit FROM {sides} WHERE {apart} ORDER BY hit DESC LIMIT 1)"
