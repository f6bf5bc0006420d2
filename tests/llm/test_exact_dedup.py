"""Exact dedup: against SQL, under a weak hash, on odd tables."""

import hashlib

from compare import connect, rows
from pyspark.sql import functions as F

from skyweave.llm import exact_dedup, queries
from skyweave.llm.sql import ORACLES

SMALL = "/root/testdata/sf0.001"
BLANKS = str.maketrans("", "", exact_dedup.BLANKS)


def groups(table: list) -> list:
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text) rows."""
    known: dict = {}
    for at, (i, t) in enumerate(table):
        known.setdefault((t or "").translate(BLANKS), []).append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for x, members in known.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m == best, hashlib.sha256(x.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def found(docs, **how) -> list:
    return sorted(map(tuple, exact_dedup.exact_groups(docs, **how).drop("row").collect()), key=str)


ODD = [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c"), (4, "a b"), (5, "ab"), (5, "a  b"), (5, "a  b"), (None, "ab\n"), (None, "é é"), (6, "éé"), (7, "a　b"), (8, "A B"), (9, "x" * 200_000), (10, "x " * 200_000), (11, "y"), (11, "y"), (11, "z")]
SCHEMA = "doc_id long, text string, hash string, row string, sha int, best string, bytes string, of int"


def test_against_sql(spark):
    got, want = queries.QUERIES["op13_exact_dedup"](spark, SMALL).toPandas(), connect(SMALL).execute(ORACLES["op13_exact_dedup"]).df()
    assert rows(got) == rows(want)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, *[None] * 6) for i, t in ODD], SCHEMA)
    assert found(docs) == groups(ODD)
    assert found(docs.limit(0)) == []
    assert found(docs.repartition(7, "doc_id").drop("hash", "row")) == groups(ODD)


def test_bytes_tell_texts_of_one_hash_apart(spark):
    """Under a hash of 4 bits most groups hold several texts."""
    docs = spark.createDataFrame([(i, f"text {i % 40} {'again ' * (i % 3)}") for i in range(200)] + ODD, "doc_id long, text string")
    weak = lambda text: F.substring(F.md5(text), 1, 1)
    assert exact_dedup.clashes(docs, weak).count() > 10 and exact_dedup.clashes(docs).count() == 0
    assert found(docs, hashed=weak) == found(docs) == groups([tuple(r) for r in docs.collect()])


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, t, *["c"] * 3, k, None, 1) for k, (i, t) in enumerate(ODD)], "doc_id long, text string, _row string, hash string, row string, sha int, best string, of int")
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    stays = [(3, " \t\n\r\x0b\x0c"), (5, "a  b"), (None, "é é"), (7, "a　b"), (8, "A B"), (10, "x " * 200_000), (11, "y"), (11, "z")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(stays, key=str)


def test_one_group_of_a_third_of_all_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    got = exact_dedup.exact_groups(docs)
    assert got.filter("group_size = 10000 and keep_id = 0").count() == 10_000 and got.filter("kept").count() == 20_001
