"""Gaussian naive Bayes on standardised features, all rounds and folds in one job."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.moments import fold_moments, train_moments
from faultline.operators.scaling import scaler_from

SMOOTHING = 1e-9
ABSENT = 1e300


def fit(
    folded: DataFrame, features: list[str], k: int, by: list[str] = ["round"], moments: DataFrame | None = None
) -> DataFrame:
    """One row per (by, fold): `model`, per feature the scaling and both labels' mean and half
    precision, and `constant`, what does not depend on the row. `moments` are those of the rows, where they
    are at hand."""
    moments = fold_moments(folded, features, by) if moments is None else moments
    key = [*by, "fold"]
    scaler = scaler_from(train_moments(moments, k, by)).withColumnsRenamed(
        {"mean": "centre", "n": "n_all"}
    )
    # The largest scaled variance is 1 unless every feature is constant.
    scaled = (
        train_moments(moments, k, by, per_label=True)
        .join(scaler, [*key, "feature"])
        .select(
            *key,
            "label",
            F.array_position(F.lit(features), F.col("feature")).alias("place"),
            "centre",
            "scale",
            ((F.col("mean") - F.col("centre")) / F.col("scale")).alias("mu"),
            (F.col("var_pop") / (F.col("scale") * F.col("scale")) + SMOOTHING).alias("var"),
            F.ln(F.col("n") / F.col("n_all")).alias("log_prior"),
        )
    )
    def of(y: int, c: str) -> Column:
        return F.max(F.when(F.col("label") == y, F.col(c)))

    def half_precision(y: int) -> Column:
        return F.coalesce(0.5 / of(y, "var"), F.lit(0.0))

    def constant(y: int) -> Column:
        return of(y, "log_prior") / len(features) - 0.5 * F.ln(2 * math.pi * of(y, "var"))

    # A label absent from training can never win.
    absent = F.when(constant(1).isNull(), -ABSENT).when(constant(0).isNull(), ABSENT)
    per_feature = scaled.groupBy(*key, "place").agg(
        F.first("centre").alias("centre"),
        F.first("scale").alias("scale"),
        *(F.coalesce(of(y, "mu"), F.lit(0.0)).alias(f"mu{y}") for y in (0, 1)),
        *(half_precision(y).alias(f"half{y}") for y in (0, 1)),
        F.coalesce(absent, constant(1) - constant(0)).alias("constant"),
    )
    entry = F.struct("place", "centre", "scale", "mu0", "half0", "mu1", "half1")
    return per_feature.groupBy(*key).agg(
        F.sort_array(F.collect_list(entry)).alias("model"), F.sum("constant").alias("constant")
    )


def _log_odds(features: list[str]) -> Column:
    """Log of how much likelier label 1 is than label 0."""
    terms = []
    for i, c in enumerate(features):
        m = F.col("model")[i]
        z = (F.col(c) - m["centre"]) / m["scale"]
        far0, far1 = z - m["mu0"], z - m["mu1"]
        terms.append(far0 * far0 * m["half0"] - far1 * far1 * m["half1"])
    return reduce(lambda a, b: a + b, terms) + F.col("constant")


def predict(
    rows: DataFrame, fitted: DataFrame, features: list[str], keys: list[str], by=["round"]
) -> DataFrame:
    p = F.when(_log_odds(features) > 0, 1).otherwise(0)
    return rows.join(F.broadcast(fitted), [*by, "fold"]).select(
        *by, "fold", *keys, F.col("label").alias("y"), p.alias("p")
    )
