"""Scores of predicted classes: long confusion matrices (true_label, pred_label, n)."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import best_match


def confusion(pred: DataFrame, true: DataFrame, key: str = "id") -> DataFrame:
    """Counts on common ids, all labels on both axes. What is crossed are the distinct labels."""
    counts = true.select(key, F.col("label").alias("true_label")).join(pred.select(key, F.col("label").alias("pred_label")), key).groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    labels = counts.select(F.col("true_label").alias("l")).union(counts.select("pred_label")).distinct()
    cells = labels.select(F.col("l").alias("true_label")).crossJoin(F.broadcast(labels.select(F.col("l").alias("pred_label"))))
    return cells.join(counts, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def best_order(matrix: DataFrame) -> tuple[dict, float]:
    """Predicted class for each true class, and the accuracy; the matrix (classes squared) reaches the driver."""
    rows = matrix.collect()
    names, preds = sorted({r.true_label for r in rows}), sorted({r.pred_label for r in rows})
    counts = np.zeros((len(names), len(preds)))
    for r in rows:
        counts[names.index(r.true_label), preds.index(r.pred_label)] = r.n
    match = best_match(counts)
    hit = sum(counts[i, j] for i, j in match.items())
    return {names[i]: preds[j] for i, j in match.items()}, float(hit / counts.sum()) if counts.sum() else float("nan")


def class_scores(matrix: DataFrame) -> DataFrame:
    """Recall, false discovery rate, precision, accuracy, and counts of each class; NULL where nothing is divided."""
    rows = matrix.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("n_true"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("n_pred"))
    total = matrix.agg(F.sum("n").alias("total"))
    j = rows.join(cols, "label").join(F.broadcast(total))
    fp, fn = F.col("n_pred") - F.col("tp"), F.col("n_true") - F.col("tp")
    accuracy = F.try_divide(F.col("total") - fp - fn, "total")
    return j.select("label", F.try_divide("tp", "n_true").alias("recall"), F.try_divide(fp, "n_pred").alias("false_discovery"), F.try_divide("tp", "n_pred").alias("precision"), accuracy.alias("accuracy"), "n_true", "n_pred")


def summary(scores: DataFrame, labels: list, digits: int = 2) -> DataFrame:
    """J4."""
    return scores.filter(F.col("label").isin(labels)).select("label", *(F.round(c, digits).alias(c) for c in ("recall", "false_discovery", "precision", "accuracy")), "n_true", "n_pred")


def cases(pred: DataFrame, true: DataFrame, n: int | None = None, key: str = "id") -> DataFrame:
    """(label, kind, id): true positives, false positives and false negatives of each class (the first n by id)."""
    both = true.select(key, F.col("label").alias("true_label")).join(pred.select(key, F.col("label").alias("pred_label")), key)
    hit = both.filter("true_label = pred_label").select(F.col("true_label").alias("label"), F.lit("TP").alias("kind"), key)
    miss = both.filter("true_label <> pred_label")
    out = hit.union(miss.select("pred_label", F.lit("FP"), key)).union(miss.select("true_label", F.lit("FN"), key))
    if n is None:
        return out
    rank = F.row_number().over(Window.partitionBy("label", "kind").orderBy(key))
    return out.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")


def class_means(pred: DataFrame, true: DataFrame, catalog: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Means of catalog columns for true and for predicted members of each class."""
    members = true.select(key, "label", F.lit("true").alias("kind")).union(pred.select(key, "label", F.lit("pred")))
    return members.join(catalog, key).groupBy("label", "kind").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in columns))


def single_label(rows: DataFrame, priority: list[str], key: str = "id") -> DataFrame:
    """Of several labels the first of a priority list; labels that are not listed come last, by name."""
    order = F.array_position(F.array(*map(F.lit, priority)), F.col("l"))
    each = rows.select(key, F.explode(F.split("otype", r"\|")).alias("l"))
    rank = F.struct(F.when(order == 0, len(priority) + 1).otherwise(order).alias("o"), F.col("l"))
    return each.groupBy(key).agg(F.min_by("l", rank).alias("label"))


def list_accuracy(pred: DataFrame, rows: DataFrame, lists: dict[str, list[str]], key: str = "id") -> DataFrame:
    """The share of equal labels for each priority list."""
    out = None
    for name, priority in lists.items():
        both = single_label(rows, priority, key).join(pred.select(key, F.col("label").alias("pred_label")), key)
        row = both.agg(F.avg((F.col("label") == F.col("pred_label")).cast("double")).alias("accuracy")).select(F.lit(name).alias("list"), "accuracy")
        out = row if out is None else out.unionByName(row)
    return out
