"""Confusion counts and the scores that follow from them, per group of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom == 0, 0.0).otherwise(top / F.nullif(bottom, F.lit(0)))


def confusion(predictions: DataFrame, by: list[str]) -> DataFrame:
    """tn, fp, fn, tp and predicted counts of labels `y` and predictions `p`."""
    y, p = F.col("y"), F.col("p")
    return predictions.groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.sum(p.cast("bigint")).alias("pred_pos"),
        F.sum(1 - p.cast("bigint")).alias("pred_neg"),
    )


def _counts():
    return F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn")


def binary_prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of label 1, and F1 of label 0; undefined ratios are 0."""
    tp, tn, fp, fn = _counts()
    return counts.withColumns(
        {
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1binp": _ratio(2 * tp, 2 * tp + fp + fn),
            "f1binn": _ratio(2 * tn, 2 * tn + fp + fn),
        }
    )


def f1_averages(counts: DataFrame) -> DataFrame:
    """F1 over both labels: micro, plain mean over the labels seen, and weighted by support."""
    tp, tn, fp, fn = _counts()
    n = tp + tn + fp + fn
    f1p = _ratio(2 * tp, 2 * tp + fp + fn)
    f1n = _ratio(2 * tn, 2 * tn + fp + fn)
    seen = F.when(tp + fp + fn > 0, 1).otherwise(0) + F.when(tn + fp + fn > 0, 1).otherwise(0)
    return counts.withColumns(
        {
            "f1micro": _ratio(tp + tn, n),
            "f1macro": _ratio(f1p + f1n, seen),
            "f1weighted": _ratio(f1p * (tp + fn) + f1n * (tn + fp), n),
        }
    )


def accuracy(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = _counts()
    return counts.withColumn("accuracy", _ratio(tp + tn, tp + tn + fp + fn))


def scores(predictions: DataFrame, by: list[str]) -> DataFrame:
    """All of the above."""
    return accuracy(f1_averages(binary_prf(confusion(predictions, by))))
