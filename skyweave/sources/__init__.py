"""Sources and sinks: series, catalogs, labels, event times, stored products."""

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a sample before compression, and bytes of a bucket over all sectors.
SAMPLE_BYTES, BUCKET_BYTES = 32, 1 << 30
SERIES = "t double, intensity double, error double"
#: Fixed columns of the catalog files.
CATALOG = "ID long, ra double, dec double, Teff double, rad double, mass double, GAIAmag double, d double, Tmag double, objType string"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; set here only where it is unset and all is one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="skyweave-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written and read again: the lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """With column `number`, from 0 in the given order over the whole table. Ranges are sorted apart; only their row
    counts meet."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(ranges.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    return placed.join(F.broadcast(before), "_range").withColumn("number", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def dealt(lc: DataFrame, key: str = "obj_id") -> DataFrame:
    """lc dealt by object to as many partitions as the session shuffles to. For work on whole series that takes far longer
    than its bytes tell: partitions of few bytes, which Spark merges otherwise, stay apart. Bucketed tables need none."""
    return lc.repartition(int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def series_buckets(lc: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES over all sectors, from the number of samples; at least one for each core."""
    return max(lc.sparkSession.sparkContext.defaultParallelism, math.ceil(lc.count() * SAMPLE_BYTES / BUCKET_BYTES))


def write_series(lc: DataFrame, name: str, path: str | None = None, buckets: int | None = None, key: str = "obj_id") -> DataFrame:
    """A table of cleaned series, partitioned by sector and bucketed by object, sorted by time; returns it as read back.

    An object's samples of all sectors are in one bucket, so that what works on one object (groups, windows, joins by
    object) needs no exchange after the scan. A bucket is one file a sector. `path`: a shared folder in place of the
    warehouse."""
    n = buckets or series_buckets(lc)
    out = lc.repartition(n, key).write.mode("overwrite").partitionBy("sector").bucketBy(n, key).sortBy(key, "t")
    (out.option("path", path) if path else out).saveAsTable(name, format="parquet")
    return lc.sparkSession.table(name)


def read_sector(series: DataFrame, sector: int) -> DataFrame:
    """A1: of a stored table only the partition of the sector is read."""
    return series.filter(F.col("sector") == sector)


def read_labelled_series(spark: SparkSession, path: str, name_pattern: str = r"rflx_([^_/]+)_([^_/.]+)") -> DataFrame:
    """A2: space-delimited series; the label is joined from two parts of the file's path."""
    rows = spark.read.schema(SERIES).option("sep", " ").csv(path)
    source = F.col("_metadata.file_path")
    return rows.select("*", F.concat(F.regexp_extract(source, name_pattern, 1), F.regexp_extract(source, name_pattern, 2)).alias("label"))


def write_cleaned_series(lc: DataFrame, path: str, key: str = "obj_id") -> None:
    """Files as A3 reads them, one an object: an object's samples meet before they are written, or else each task writes a
    file for each object that it sees. Tasks commit their own files (committer 2): the driver moves none."""
    name = F.concat(F.lit("lc_"), F.col(key), F.lit("_cleaned"))
    rows = lc.select("t", F.lit(0.0).alias("skipped"), "flux", name.alias("name"))
    out = rows.repartition(int(lc.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name").write.partitionBy("name")
    out.option("sep", " ").option("header", True).option("mapreduce.fileoutputcommitter.algorithm.version", 2).csv(path)


def read_cleaned_series(spark: SparkSession, path: str, id_pattern: str = r"lc_(\d+)_cleaned") -> DataFrame:
    """A3: space-delimited with one header line; columns 0 and 2, the id from the file's path. Folders are only looked
    through: their names are not read as columns, whose values the driver would keep for each file; they are listed by a few tasks a core, where Spark's default is a task
    for each of up to 10,000 folders."""
    setting = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(4 * spark.sparkContext.defaultParallelism))
    try:
        rows = spark.read.schema("t double, skipped double, flux double").option("sep", " ").option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).csv(path)
    finally:
        spark.conf.set(setting, before)
    return rows.select(F.regexp_extract("_metadata.file_path", id_pattern, 1).cast("long").alias("obj_id"), "t", "flux")


def read_catalog(spark: SparkSession, path: str, schema: str = CATALOG, header: bool = True) -> DataFrame:
    """A4."""
    return spark.read.schema(schema).option("header", header).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A5: rows id, otype, main_id."""
    return spark.read.schema("id long, otype string, main_id string").csv(path)


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Lines `KEY = description`; a trailing uncertainty flag of the key goes."""
    parts = F.split("value", " = ", 2)
    lines = spark.read.text(path).filter(F.size(parts) == 2)
    return lines.select(F.regexp_replace(F.trim(parts[0]), "[:?*]$", "").alias("otype"), F.trim(parts[1]).alias("description"))


def read_event_times(spark: SparkSession, path: str, header_lines: int = 6) -> DataFrame:
    """The fourth token of each line after a file's header, without its last character. Files may be split: lines of a
    split come in order, and the header is at the start of a file's first one."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    first = lines.filter("block = 0").groupBy("file").agg(F.min("line").alias("first"))
    body = lines.join(first, "file").filter((F.col("block") > 0) | (F.col("line") - F.col("first") >= header_lines)).filter(F.length(F.trim("value")) > 0)
    token = F.get(F.split(F.trim("value"), r"\s+"), F.lit(3))
    return body.withColumn("tok", token).select(F.expr("try_cast(left(tok, length(tok) - 1) as double)").alias("event_t"))


def write_scores(scores: DataFrame, path: str, as_csv: bool = False) -> None:
    """A9."""
    scores.write.mode("overwrite").option("header", True).csv(path) if as_csv else scores.write.mode("overwrite").parquet(path)


def read_aligned(spark: SparkSession, path: str, targets: DataFrame, key: str = "obj_id") -> DataFrame:
    """A10: stored products for a list of targets, with `missing` for ids that have none."""
    stored_rows = spark.read.parquet(path).withColumn("_there", F.lit(1))
    return targets.select(key).distinct().join(stored_rows, key, "left").withColumn("missing", F.col("_there").isNull().cast("int")).drop("_there")
