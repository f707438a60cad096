"""Perceptron, linear SVM, and boosted trees of large folds, from Spark's ML library.

These fit one model per (round, fold); the fits of several cells run side
by side over one staged table of standardised rows. Perceptrons by L-BFGS are trained by `perceptron`, all cells in
one job a pass; the library draws their first weights and predicts. Hidden units are sigmoid. Trees come from here only where a
fold is too large for `trees.boost`; depths above 30 become 30, the most Spark allows, and `min_samples_split`
is held as instances per node.
"""

from __future__ import annotations

import time
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.models import perceptron

MAX_DEPTH = 30


def _depth(value: int | None) -> int:
    return MAX_DEPTH if value is None else min(value, MAX_DEPTH)


def _per_node(min_samples_split: int) -> int:
    return max(1, min_samples_split // 2)


def estimator(name: str, config: dict, features: int, rows: int, seed: int) -> Estimator:
    shared = {"featuresCol": "x", "labelCol": "label"}
    if name == "GBOOST":
        return GBTClassifier(
            maxIter=config["n_estimators"],
            maxDepth=_depth(config["max_depth"]),
            minInstancesPerNode=_per_node(config["min_samples_split"]),
            stepSize=0.1,
            seed=seed,
            **shared,
        )
    if name == "MLP":
        return MultilayerPerceptronClassifier(
            layers=[features, config["hidden_layer_sizes"], 2],
            solver={"lbfgs": "l-bfgs", "sgd": "gd"}[config["solver"]],
            maxIter=config["max_iter"],
            seed=seed,
            **shared,
        )
    if name == "SVM":
        return LinearSVC(regParam=1.0 / (config["C"] * max(rows, 1)), **shared)
    raise ValueError(f"no such model: {name}")


def _unmoved(
    spark: SparkSession, config: dict, features: int, seed: int, weights: DenseVector | None = None
) -> MultilayerPerceptronClassificationModel:
    """A perceptron with these weights, or those that the seed draws: a fit of no steps."""
    rows = [(0.0, Vectors.dense([0.0] * features)), (1.0, Vectors.dense([1.0] * features))]
    made = estimator("MLP", config | {"max_iter": 0}, features, 2, seed)
    if weights is not None:
        made.setInitialWeights(weights)
    return made.fit(spark.createDataFrame(rows, ["label", "x"]))


def _perceptrons(
    config: dict, scaled: DataFrame, features: list[str], cells: list[tuple], by: list[str]
) -> tuple[dict[tuple, MultilayerPerceptronClassificationModel], float]:
    """The trained model of every cell that has training rows, and a cell's share of the time."""
    began, spark, n = time.monotonic(), scaled.sparkSession, len(features)
    seeds = [dict(zip(by, cell)).get("round", 0) for cell in cells]
    drawn = {seed: _unmoved(spark, config, n, seed).weights.toArray() for seed in set(seeds)}
    number = F.coalesce(*(F.when(_is(by, cell), at) for at, cell in enumerate(cells)))
    train = scaled.where(F.col("split") == "train")
    start = {at: drawn[seed] for at, seed in enumerate(seeds)}
    found = perceptron.fit(train, number, features, config["hidden_layer_sizes"], config["max_iter"], start)
    models = {cells[at]: _unmoved(spark, config, n, seeds[at], Vectors.dense(w)) for at, w in found.items()}
    return models, (time.monotonic() - began) / max(1, len(found))


def _is(by: list[str], cell: tuple) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(by, cell)))


def fit_predict(
    name: str,
    config: dict,
    scaled: DataFrame,
    features: list[str],
    keys: list[str],
    cells: Iterable[tuple],
    by: list[str] = ["round", "fold"],
    parallelism: int = 5,
) -> DataFrame:
    """Predict the validation rows of every (by) combination in `cells`, several fits at a time.

    `scaled` holds `by`, `split`, `label` and standardised features; stage it first, as every fit
    reads it. The seed is the round. `train_seconds` is the time of the fit, or a cell's share of it.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="x")
    rows = assembler.transform(scaled.withColumn("label", F.col("label").cast("double")))
    cells, trained, share = list(cells), {}, 0.0
    if name == "MLP" and config["solver"] == "lbfgs":
        trained, share = _perceptrons(config, scaled, features, cells, by)

    def run(cell: tuple) -> DataFrame:
        own = rows.where(_is(by, cell))
        model, spent = trained.get(cell), share
        if model is None:
            train = own.where(F.col("split") == "train").select("x", "label")
            size = train.count() if name == "SVM" else 0
            seed = dict(zip(by, cell)).get("round", 0)
            began = time.monotonic()
            model = estimator(name, config, len(features), size, seed).fit(train)
            spent = time.monotonic() - began
        test = own.where(F.col("split") != "train").select(*by, "split", *keys, "x", "label")
        return model.transform(test).select(
            *by,
            "split",
            *keys,
            F.col("label").cast("int").alias("y"),
            F.col("prediction").cast("int").alias("p"),
            F.lit(spent).alias("train_seconds"),
        )

    with ThreadPoolExecutor(parallelism) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(run), cells))
    return reduce(lambda a, b: a.unionByName(b), parts)
