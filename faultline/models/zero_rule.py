"""The most frequent training label, for every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fit(folded: DataFrame, k: int, by: list[str] = ["round"]) -> DataFrame:
    """(by, fold, p): the larger training label; the smaller one among equals."""
    own = folded.groupBy(*by, F.col("fold").alias("own"), "label").agg(F.count(F.lit(1)).alias("n"))
    sides = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(
        ~F.col("own").eqNullSafe(F.col("fold"))
    )
    counts = sides.groupBy(*by, "fold", "label").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", (-F.col("label")).alias("minus")))
    return counts.groupBy(*by, "fold").agg((-best["minus"]).alias("p"))


def predict(rows: DataFrame, fitted: DataFrame, keys: list[str], by=["round"]) -> DataFrame:
    return rows.join(F.broadcast(fitted), [*by, "fold"]).select(
        *by, "fold", *keys, F.col("label").alias("y"), "p"
    )
