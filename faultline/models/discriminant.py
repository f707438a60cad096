"""Linear and quadratic discriminants from summed products, all rounds and folds in one pass.

Covariances come from the product sums of the training sides; only the 30 by 30 solves, a few
hundred numbers per fold, run inside one task each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from faultline.operators.moments import fold_products, side_products
from faultline.operators.scaling import NOISE

RANK_TOLERANCE = 1e-10


def _class_statistics(group: pd.DataFrame, size: int) -> dict[int, tuple]:
    """label -> (row count, mean, scatter matrix) from the (i, j, s) rows of one fold."""
    statistics = {}
    for label, rows in group.groupby("label"):
        full = np.zeros((size + 1, size + 1))
        i, j = rows["i"].to_numpy() + 1, rows["j"].to_numpy() + 1
        full[i, j] = rows["s"]
        full[j, i] = rows["s"]
        n, total = full[0, 0], full[0, 1:]
        scatter = full[1:, 1:] - np.outer(total, total) / n
        statistics[int(label)] = (n, total / n, scatter)
    return statistics


def _shift(group: pd.DataFrame, size: int) -> np.ndarray:
    shift = np.zeros(size)
    own = group[group["j"] >= 0]
    shift[own["j"].to_numpy()] = own["shift_j"]
    return shift


def _scaling(statistics: dict[int, tuple], shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of the whole training side."""
    n = sum(s[0] for s in statistics.values())
    mean = sum(s[0] * s[1] for s in statistics.values()) / n
    square = sum(s[2] + s[0] * np.outer(s[1] - mean, s[1] - mean) for s in statistics.values())
    scale = np.sqrt(np.maximum(np.diag(square), 0) / n)
    return mean, np.where(scale <= NOISE * np.abs(mean + shift), 1.0, scale)


def _whitening(covariance: np.ndarray) -> tuple[np.ndarray, float]:
    """(W, log pseudo-determinant) with W' W the pseudo-inverse."""
    value, vector = np.linalg.eigh(covariance)
    kept = value > RANK_TOLERANCE * max(value.max(), 0.0)
    white = np.zeros_like(vector.T)
    white[kept] = vector.T[kept] / np.sqrt(value[kept])[:, None]
    return white, float(np.log(value[kept]).sum())


def _solve_linear(statistics, mean, scale) -> tuple[np.ndarray, float]:
    n = sum(s[0] for s in statistics.values())
    pooled = sum(s[2] for s in statistics.values()) / (n - len(statistics))
    white, _ = _whitening(pooled / np.outer(scale, scale))
    inverse = white.T @ white
    weight, bias = np.zeros(len(mean)), 0.0
    for label, sign in ((1, 1.0), (0, -1.0)):
        count, centre, _ = statistics[label]
        mu = (centre - mean) / scale
        weight += sign * (inverse @ mu)
        bias += sign * (-0.5 * mu @ inverse @ mu + np.log(count / n))
    return weight, bias


def _train_products(folded, features, k, by) -> DataFrame:
    sides = side_products(fold_products(folded, features, by), k, by, per_label=True)
    return sides.where(F.col("split") == "train")


def fit_linear(folded: DataFrame, features: list[str], k: int, by=["round"]) -> DataFrame:
    """(by, fold, weights, bias) on raw features; label 1 where weights . x + bias > 0."""
    products = _train_products(folded, features, k, by)
    key = [*by, "fold"]
    size = len(features)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        statistics = _class_statistics(group, size)
        out = {c: [group[c].iloc[0]] for c in key}
        if len(statistics) < 2:
            only = next(iter(statistics))
            return pd.DataFrame(out | {"weights": [np.zeros(size)], "bias": [only - 0.5]})
        shift = _shift(group, size)
        mean, scale = _scaling(statistics, shift)
        weight, bias = _solve_linear(statistics, mean, scale)
        raw = weight / scale
        return pd.DataFrame(
            out | {"weights": [raw], "bias": [bias - float(raw @ (mean + shift))]}
        )

    schema = T.StructType(
        [products.schema[c] for c in key]
        + [T.StructField("weights", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType())]
    )
    return products.groupBy(*key).applyInPandas(solve, schema)


def predict_linear(rows, fitted, features, keys, by=["round"]) -> DataFrame:
    terms = (F.col("weights")[i] * F.col(c) for i, c in enumerate(features))
    score = reduce(lambda a, b: a + b, terms) + F.col("bias")
    return rows.join(F.broadcast(fitted), [*by, "fold"]).select(
        *by, "fold", *keys, F.col("label").alias("y"), F.when(score > 0, 1).otherwise(0).alias("p")
    )


def fit_quadratic(folded: DataFrame, features: list[str], k: int, by=["round"]) -> DataFrame:
    """(by, fold, label, centre, whitening, constant) on raw features.

    A label's score is constant - |whitening (x - centre)|^2 / 2.
    """
    products = _train_products(folded, features, k, by)
    key = [*by, "fold"]
    size = len(features)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        statistics = _class_statistics(group, size)
        shift = _shift(group, size)
        _, scale = _scaling(statistics, shift)
        total = sum(s[0] for s in statistics.values())
        out = []
        for label, (n, centre, scatter) in statistics.items():
            white, log_det = _whitening(scatter / np.outer(scale, scale) / max(n - 1, 1))
            out.append(
                {c: group[c].iloc[0] for c in key}
                | {
                    "label": label,
                    "centre": centre + shift,
                    "whitening": (white / scale).ravel(),
                    "constant": np.log(n / total) - 0.5 * log_det,
                }
            )
        return pd.DataFrame(out)

    array = T.ArrayType(T.DoubleType())
    schema = T.StructType(
        [products.schema[c] for c in key]
        + [T.StructField("label", T.IntegerType())]
        + [T.StructField("centre", array), T.StructField("whitening", array)]
        + [T.StructField("constant", T.DoubleType())]
    )
    return products.groupBy(*key).applyInPandas(solve, schema)


def predict_quadratic(rows, fitted, features, keys, by=["round"]) -> DataFrame:
    """Scores Arrow batches against the fitted models, two small rows per fold."""
    key = [*by, "fold"]
    size = len(features)
    models: dict[tuple, dict[int, tuple]] = {}
    for m in fitted.collect():
        at = tuple(m[c] for c in key)
        models.setdefault(at, {})[m["label"]] = (
            np.array(m["centre"]),
            np.array(m["whitening"]).reshape(size, size),
            m["constant"],
        )
    shared = rows.sparkSession.sparkContext.broadcast(models)
    own = rows.select(*key, *keys, F.col("label").cast("int").alias("y"), *features)

    def score(batches):
        for batch in batches:
            for at, part in batch.groupby(key, sort=False):
                x = part[features].to_numpy(dtype=float)
                value = np.full((len(x), 2), -np.inf)
                for label, (centre, white, constant) in shared.value.get(at, {}).items():
                    z = (x - centre) @ white.T
                    value[:, label] = constant - 0.5 * (z * z).sum(axis=1)
                yield part[[*key, *keys, "y"]].assign(p=(value[:, 1] > value[:, 0]).astype("int32"))

    schema = T.StructType(
        [own.schema[c] for c in [*key, *keys, "y"]] + [T.StructField("p", T.IntegerType())]
    )
    return own.where(F.col("fold").isNotNull()).mapInPandas(score, schema)
