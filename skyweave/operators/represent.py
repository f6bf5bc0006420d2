"""Representation, reconstruction and splits."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..sources import numbered, stored


def right_vectors(series: DataFrame, components: int, spare: int = 20, most_rounds: int = 60, tol: float = 1e-10) -> np.ndarray:
    """The first right singular vectors of the matrix with column `flux` as rows, by subspace iteration.

    A round sends T x (components + spare) numbers to the tasks and gets their products back, summed in blocks of the
    axis; it is exact at once where that covers the axis. The axis of T samples is all that the driver must hold."""
    size = series.agg(F.max(F.size("flux"))).first()[0] or 0
    width = min(size, max(64, components + spare))
    q = np.eye(size, width) if width == size else np.linalg.qr(np.random.default_rng(0).normal(size=(size, width)))[0]
    cuts = list(range(0, size, 4096))
    before = None
    for _ in range(most_rounds if width < size else 1):
        shared = series.sparkSession.sparkContext.broadcast(q)

        def products(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, width))
            for batch in batches:
                if batch.num_rows:
                    x = batch.column("flux").flatten().to_numpy().reshape(batch.num_rows, size)
                    total += x.T @ (x @ shared.value)
            yield pa.record_batch([pa.array(range(len(cuts)), pa.int32()), pa.array([total[c : c + 4096].tobytes() for c in cuts], pa.binary())], ["cut", "part"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_buffer()) for b in table.column("part"))
            return pa.table({"cut": table.column("cut").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

        rows = series.select("flux").mapInArrow(products, "cut int, part binary").groupBy("cut").applyInArrow(add, "cut int, part binary").collect()
        y = np.concatenate([np.frombuffer(r.part) for r in sorted(rows, key=lambda r: r.cut)]).reshape(size, width) if rows else q * 0
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:components]
        found = q @ turn[:, order]
        if before is not None and np.linalg.norm(found - before @ (before.T @ found)) < tol:
            break
        before, q = found, np.linalg.qr(y)[0] if width < size else q
    return found if size else np.zeros((0, components))


def remove_systematics(series: DataFrame, components: int = 5, key: str = "obj_id") -> DataFrame:
    """series is (key, flux array<double> on one common axis). Standardised series are regressed on the right
    singular vectors of their matrix (not centred across series); what is left stays."""
    mean = F.aggregate("flux", F.lit(0.0), lambda s, x: s + x) / F.size("flux")
    unit = series.withColumn("_m", mean).withColumn("_s", F.sqrt(F.aggregate(F.transform("flux", lambda x: (x - F.col("_m")) * (x - F.col("_m"))), F.lit(0.0), lambda s, x: s + x) / F.size("flux")))
    unit = stored(unit.select(key, F.transform("flux", lambda x: (x - F.col("_m")) / F.when(F.col("_s") == 0, 1e-8).otherwise(F.col("_s"))).alias("flux")), "unit")
    basis = right_vectors(unit, components)
    shared = series.sparkSession.sparkContext.broadcast(basis)

    def leave(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for part in parts:
            if len(part):
                x = np.stack(part["flux"].to_numpy())
                part = part.assign(flux=list(x - (x @ v) @ v.T))
            yield part

    return unit.mapInPandas(leave, f"{key} long, flux array<double>")


def pca(features: DataFrame, n: int, key: str = "obj_id") -> DataFrame:
    """projection to n components, each with its largest loading positive."""
    vectors = features.select(key, array_to_vector("features").alias("v"))
    model = PCA(k=n, inputCol="v", outputCol="p").fit(vectors)
    loading = model.pc.toArray()
    signs = np.sign(loading[np.argmax(np.abs(loading), axis=0), np.arange(n)])
    p = vector_to_array("p")
    return model.transform(vectors).select(key, F.array(*(p[k] * float(s) for k, s in enumerate(signs))).alias("features"))


def linear_encoder(features: DataFrame, n: int) -> tuple[Callable, Callable]:
    """An encoder and a decoder from principal components, for `encode`."""
    model = PCA(k=n, inputCol="v", outputCol="p").fit(features.select(array_to_vector("features").alias("v")))
    loading = model.pc.toArray()
    return (lambda x: x @ loading), (lambda z: z @ loading.T)


def encode(features: DataFrame, encoder: Callable, decoder: Callable, key: str = "obj_id") -> DataFrame:
    """(key, features, bottleneck, reconstruction) by any callables on batches."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["features"].to_numpy()) if len(part) else np.zeros((0, 1))
            z = encoder(x) if len(part) else x
            yield part.assign(bottleneck=list(z), reconstruction=list(decoder(z)) if len(part) else [])

    return features.select(key, "features").mapInPandas(run, f"{key} long, features array<double>, bottleneck array<double>, reconstruction array<double>")


def reconstruction_error(encoded: DataFrame, powers: tuple[int, ...] = (1, 2, 3, 4, 5), key: str = "obj_id") -> DataFrame:
    """(key, power, error): mean of abs(x - reconstruction) ** power."""
    gap = F.zip_with("features", "reconstruction", lambda a, b: F.abs(a - b))
    rows = encoded.select(key, F.size("features").alias("n"), gap.alias("gap"), F.explode(F.array(*map(F.lit, powers))).alias("power"))
    total = F.aggregate(F.transform("gap", lambda x: F.pow(x, F.col("power"))), F.lit(0.0), lambda s, x: s + x)
    return rows.select(key, "power", (total / F.col("n")).alias("error"))


def ends_of_error(errors: DataFrame, n: int, powers: tuple[int, ...] = (1, 2, 3, 4, 5), key: str = "obj_id") -> DataFrame:
    """the n best and worst reconstructed objects for each power (one that is both is best), each end a limited order."""
    out = None
    for power in powers:
        own = errors.filter(F.col("power") == power).select(key, "power", "error")
        best = own.orderBy("error", key).limit(n).withColumn("end", F.lit("best"))
        worst = own.orderBy(F.desc("error"), key).limit(n).join(best.select(key), key, "left_anti").select(key, "power", "error", F.lit("worst").alias("end"))
        both = best.unionByName(worst)
        out = both if out is None else out.unionByName(both)
    return out


def split_by_error(errors: DataFrame, share: float = 0.5, power: int = 3, key: str = "obj_id") -> DataFrame:
    """part low or high: the boundary is a percentile, so no global ranking is needed."""
    own = errors.filter(F.col("power") == power).select(key, "error")
    cut = quantiles(own, [], "error", [share]).select(F.col("quantiles")[0].alias("cut"))
    return own.join(F.broadcast(cut)).select(key, "error", F.when(F.col("error") <= F.col("cut"), "low").otherwise("high").alias("part"))


def split_train_test(table: DataFrame, ratio: float, seed: int = 0, by_class: str | None = None, key: str = "obj_id") -> DataFrame:
    """`is_train` for the first int(ratio * n) rows in a seeded hash order, for each class if stratified.

    Rows are numbered in ranges of (class, hash), so neither the table nor a large class is one task."""
    part = by_class or "_all"
    keyed = table.withColumn("_hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = numbered(keyed if by_class else keyed.withColumn("_all", F.lit(0)), part, "_hash", key)
    facts = ranked.groupBy(part).agg(F.min("number").alias("_first"), F.count("*").alias("_n")).withColumnRenamed(part, "_part")
    joined = ranked.join(facts, F.col(part).eqNullSafe(F.col("_part")))
    return joined.withColumn("is_train", (F.col("number") - F.col("_first") < F.floor(F.col("_n") * ratio)).cast("int")).select(*table.columns, "is_train")


def best_setting(scan: DataFrame, score: str, largest: bool = False, setting: str = "setting") -> DataFrame:
    """the setting of the least (or largest) score, missing scores aside; ties: the least setting."""
    rows = scan.filter(F.col(score).isNotNull() & ~F.isnan(score))
    order = [F.desc(score) if largest else F.asc(score), F.asc(setting)]
    return rows.orderBy(*order).limit(1).select(setting, score)
