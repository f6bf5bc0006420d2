"""Files of cleaned series."""

from pathlib import Path

from pyspark.sql import functions as F

from skyweave import sources


def test_one_file_an_object_whatever_task_has_its_samples(spark, tmp_path):
    lc = spark.range(300).repartition(7).select((F.col("id") % 10).alias("obj_id"), (F.col("id") / 10).alias("t"), (F.col("id") * 2.0).alias("flux"))
    sources.write_cleaned_series(lc, str(tmp_path / "lc"))
    assert len(list(Path(tmp_path / "lc").rglob("*.csv"))) == 10
    got = sources.read_cleaned_series(spark, str(tmp_path / "lc"))
    assert sorted(got.collect()) == sorted(lc.collect())
