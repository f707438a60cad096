"""Standardisation of features by the training side of each fold."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, functions as F

from faultline.operators.moments import fold_moments, train_moments

# A spread below this share of the mean is rounding noise on a constant feature.
NOISE = 10 * sys.float_info.epsilon


def scaler_fit(folded: DataFrame, features: list[str], k: int, by: list[str] = ["round"]) -> DataFrame:
    """(by, fold, feature): mean and population deviation on train; a deviation of 0 becomes 1."""
    return scaler_from(train_moments(fold_moments(folded, features, by), k, by))


def scaler_from(train: DataFrame) -> DataFrame:
    spread = F.sqrt("var_pop")
    flat = spread <= NOISE * F.greatest(F.abs("mean"), F.lit(sys.float_info.min))
    return train.withColumn("scale", F.when(flat, 1.0).otherwise(spread)).drop("var_pop")


def as_row(scaler: DataFrame, features: list[str], key: list[str]) -> DataFrame:
    """One row per key, `scaling` holding (mean, scale) in feature order."""
    place = F.array_position(F.lit(features), F.col("feature"))
    entry = F.struct(place.alias("place"), "mean", "scale")
    return scaler.groupBy(*key).agg(F.sort_array(F.collect_list(entry)).alias("scaling"))


def standardize(
    rows: DataFrame, scaler: DataFrame, features: list[str], key: list[str] = ["round", "fold"]
) -> DataFrame:
    """Scale every feature by its fold's constants, one broadcast row per fold."""
    fitted = rows.join(F.broadcast(as_row(scaler, features, key)), key)
    scaled = {
        c: (F.col(c) - F.col("scaling")[i]["mean"]) / F.col("scaling")[i]["scale"]
        for i, c in enumerate(features)
    }
    return fitted.withColumns(scaled).drop("scaling")
