"""Exact dedup by a 128-bit content hash, with bytes compared inside groups, in DataFrame functions only.

Texts are equal when they are identical without their blanks (space and 09-0D). Each row is known by the MD5 of its
normalised text. Inside a group of one hash the least and the greatest text are aggregated (tasks combine first, so that
a group of any number of copies is a row a task): where they are the same bytes, all are. Where not, which no honest
corpus shows, the rows of these hashes carry their texts and are grouped by them. Of a group stays the row of the most
code points in its original text, then of the smallest doc_id, then the first.

Cases: a null text counts as empty, and empty and blank texts are one group; null doc_ids come last, and rows of them
alone have a null keep_id; of rows that repeat a doc_id each is judged, and of repeated rows one stays; an empty table
gives an empty result; other columns, whatever their names, are left out by `exact_groups` and kept by `without_copies`.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import stored

#: Fixed characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def clashes(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(hash): the hashes that texts of different bytes share."""
    texts = docs.select(normalised(F.col("text")).alias("text"))
    ends = texts.groupBy(hashed(F.col("text")).alias("hash")).agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
    return ends.filter("least <> greatest").select("hash")


def exact_groups(docs: DataFrame, row: str | None = None, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of each row of docs.

    `row` names a column that numbers the rows; without one they are numbered here."""
    text = normalised(F.col("text"))
    number = F.col(row).cast("long") if row else F.monotonically_increasing_id()
    known = [number.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), hashed(text).alias("hash"), F.unhex(F.sha2(text, 256)).alias("sha")]
    clashing = stored(clashes(docs, hashed), "clashes")
    if clashing.isEmpty():
        rows = stored(docs.select(*known, F.lit(None).cast("string").alias("bytes")), "hashes")
    else:
        carried = docs.select(*known, text.alias("bytes")).join(clashing.withColumn("clash", F.lit(True)), "hash", "left")
        rows = stored(carried.withColumn("bytes", F.when(F.col("clash"), F.col("bytes"))).drop("clash"), "hashes")
    best = F.min(F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = rows.groupBy(F.col("hash").alias("of"), F.col("bytes").alias("of_bytes")).agg(best.alias("best"), F.count("*").alias("group_size"))
    joined = rows.join(groups, (F.col("hash") == F.col("of")) & F.col("bytes").eqNullSafe(F.col("of_bytes")))
    return joined.select("row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = exact_groups(numbered, row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
