"""Boosted stumps (SAMME), all rounds and folds in one job per boosting step.

A step sums row weights by (fold, feature, bin, label) over the cluster; the driver then picks the
best split of a few thousand sums per fold. Rows keep their bins, never their history: weights
follow from the stumps chosen so far and are written back every few steps.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from faultline.session import stage

BINS = 32
REFRESH = 25


def _edges(train: DataFrame, features: list[str], by: list[str]) -> dict[tuple, list[np.ndarray]]:
    fractions = F.lit([i / BINS for i in range(1, BINS)])
    found = train.groupBy(*by).agg(
        *(F.percentile_approx(c, fractions, F.lit(10_000)).alias(c) for c in features)
    )
    return {
        tuple(row[c] for c in by): [np.unique(row[c]) for c in features] for row in found.collect()
    }


def _binned(rows: DataFrame, edges, features, keys, by) -> DataFrame:
    """`bins`: per feature, how many edges lie below the value. `weight` starts at 1."""
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    kept = [*by, "split", *keys]
    own = rows.select(*kept, F.col("label").cast("int").alias("y"), *features)

    def put(batches):
        for batch in batches:
            for at, part in batch.groupby(by, sort=False):
                if at not in shared.value:
                    continue
                bins = np.stack(
                    [
                        np.searchsorted(e, part[c].to_numpy(), side="left")
                        for c, e in zip(features, shared.value[at])
                    ],
                    axis=1,
                ).astype("int32")
                yield part[[*kept, "y"]].assign(bins=list(bins), weight=1.0)

    schema = T.StructType(
        [own.schema[c] for c in [*kept, "y"]]
        + [T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("weight", T.DoubleType())]
    )
    return own.mapInPandas(put, schema)


def _vote(bins: np.ndarray, stump: dict) -> np.ndarray:
    return np.where(bins[:, stump["feature"]] <= stump["bin"], stump["left"], stump["right"])


def _weights(bins, y, weight, stumps) -> np.ndarray:
    log = np.zeros(len(y))
    for s in stumps:
        log += s["alpha"] * (_vote(bins, s) != y)
    return weight * np.exp(log)


def _histogram(train: DataFrame, stumps: dict, by: list[str], width: int) -> DataFrame:
    shared = train.sparkSession.sparkContext.broadcast(stumps)

    def add(batches):
        for batch in batches:
            for at, part in batch.groupby(by, sort=False):
                bins, y = np.stack(part["bins"].to_numpy()), part["y"].to_numpy()
                w = _weights(bins, y, part["weight"].to_numpy(), shared.value[at])
                slot = (np.arange(width) * BINS + bins) * 2 + y[:, None]
                sums = np.bincount(slot.ravel(), np.repeat(w, width), width * BINS * 2)
                out = pd.DataFrame({"slot": np.arange(len(sums)), "w": sums})
                for name, value in zip(by, at):
                    out[name] = value
                yield out.loc[out["w"] > 0, [*by, "slot", "w"]]

    schema = T.StructType(
        [train.schema[c] for c in by]
        + [T.StructField("slot", T.LongType()), T.StructField("w", T.DoubleType())]
    )
    return train.mapInPandas(add, schema).groupBy(*by, "slot").agg(F.sum("w").alias("w"))


def _best_stump(sums: np.ndarray) -> tuple[dict, float]:
    """The split with the least weighted Gini impurity, and its share of misplaced weight."""
    total = sums[0].sum()
    left = sums.cumsum(axis=1)
    right = left[:, -1:, :] - left
    impurity = np.zeros(left.shape[:2])
    for side in (left, right):
        mass = side.sum(axis=2)
        impurity += np.where(mass > 0, 2 * side[..., 0] * side[..., 1] / np.where(mass > 0, mass, 1), 0)
    feature, at = np.unravel_index(impurity.argmin(), impurity.shape)
    l, r = left[feature, at], right[feature, at]
    error = (min(l) + min(r)) / total
    stump = {
        "feature": int(feature),
        "bin": int(at),
        "left": int(l[1] > l[0]),
        "right": int(r[1] > r[0]),
    }
    return stump, float(error)


def _reweighted(rows: DataFrame, stumps: dict, by: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(stumps)

    def update(batches):
        for batch in batches:
            for at, part in batch.groupby(by, sort=False):
                bins, y = np.stack(part["bins"].to_numpy()), part["y"].to_numpy()
                w = _weights(bins, y, part["weight"].to_numpy(), shared.value[at])
                yield part.assign(weight=w)

    return stage(rows.mapInPandas(update, rows.schema))


def fit_predict(
    scaled: DataFrame,
    features: list[str],
    keys: list[str],
    estimators: int = 50,
    by: list[str] = ["round", "fold"],
) -> DataFrame:
    """Predict every row that does not train; labels 0 and 1, the smaller one among equals."""
    edges = _edges(scaled.where(F.col("split") == "train"), features, by)
    rows = stage(_binned(scaled, edges, features, keys, by))
    train = rows.where(F.col("split") == "train")
    chosen: dict[tuple, list[dict]] = {at: [] for at in edges}
    pending: dict[tuple, list[dict]] = {at: [] for at in edges}
    open_ = set(edges)
    for step in range(estimators):
        if not open_:
            break
        table = _histogram(train, pending, by, len(features)).toPandas()
        for at, part in table.groupby(by, sort=False):
            if at not in open_:
                continue
            sums = np.zeros(len(features) * BINS * 2)
            sums[part["slot"]] = part["w"]
            stump, error = _best_stump(sums.reshape(len(features), BINS, 2))
            if error >= 0.5:
                open_.discard(at)
                continue
            stump["alpha"] = 1.0 if error <= 0 else math.log((1 - error) / error)
            chosen[at].append(stump)
            pending[at].append(stump)
            if error <= 0:
                open_.discard(at)
        if (step + 1) % REFRESH == 0:
            train = _reweighted(train, pending, by)
            pending = {at: [] for at in edges}
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def predict(batches):
        for batch in batches:
            for at, part in batch.groupby(by, sort=False):
                bins = np.stack(part["bins"].to_numpy())
                lead = np.zeros(len(part))
                for s in shared.value[at]:
                    lead += s["alpha"] * (2 * _vote(bins, s) - 1)
                yield part[[*by, "split", *keys, "y"]].assign(p=(lead > 0).astype("int32"))

    schema = T.StructType(
        [rows.schema[c] for c in [*by, "split", *keys, "y"]] + [T.StructField("p", T.IntegerType())]
    )
    return rows.where(F.col("split") != "train").mapInPandas(predict, schema)
