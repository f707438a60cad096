"""Parameter grids: named value lists, their combinations, and the defaults."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession

# The parameter lists searched per classifier. Models without lists have no grid and
# run on their defaults. None as a depth means as deep as Spark allows.
GRIDS: dict[str, dict[str, list]] = {
    "ADA": {"n_estimators": [5, 25, 50, 75, 100, 250, 500, 1000], "algorithm": ["SAMME"]},
    "DT": {
        "criterion": ["gini", "entropy"],
        "splitter": ["best", "random"],
        "max_depth": [None, 5, 10, 50],
        "min_samples_split": [2, 5, 10],
    },
    "GBOOST": {
        "n_estimators": [50, 100, 250],
        "min_samples_split": [2, 5, 10],
        "max_depth": [5, 10, 50],
    },
    "1NN": {},
    "3NN": {},
    "5NN": {},
    "KNN": {"n_neighbors": [1, 3, 5, 7, 10, 15]},
    "RF": {
        "max_depth": [None, 5, 10, 50],
        "n_estimators": [10, 25, 50, 100, 500],
    },
    "SVM": {"kernel": ["linear"], "C": [1.0]},
    "GNB": {},
    "LDA": {},
    "QDA": {},
    "MLP": {"hidden_layer_sizes": [128, 256, 512], "solver": ["lbfgs", "sgd"], "max_iter": [500]},
    "ZERORULE": {"strategy": ["most_frequent"]},
}

# What a model runs with outside a search.
DEFAULTS: dict[str, dict] = {
    "ADA": {"n_estimators": 50},
    "DT": {"criterion": "gini", "max_depth": None, "min_samples_split": 2},
    "GBOOST": {"n_estimators": 100, "max_depth": 3, "min_samples_split": 2},
    "KNN": {"n_neighbors": 5},
    "RF": {"n_estimators": 100, "max_depth": None},
    "SVM": {"kernel": "linear", "C": 1.0},
    "MLP": {"hidden_layer_sizes": 100, "solver": "lbfgs", "max_iter": 200},
}


def combinations(lists: dict[str, list], fixed: dict | None = None) -> list[dict]:
    """Every combination in product order, the last list turning fastest, plus fixed settings."""
    if not lists:
        return []
    return [dict(zip(lists, values)) | (fixed or {}) for values in itertools.product(*lists.values())]


def configurations(classifier: str) -> list[dict]:
    """The grid of a classifier, or its defaults alone where it has none."""
    return combinations(GRIDS[classifier]) or [DEFAULTS.get(classifier, {})]


def param_grid(spark: SparkSession, classifiers: list[str] | None = None) -> DataFrame:
    """(classifier, config_id, name, value) of every grid."""
    rows = [
        (name, i, key, str(value))
        for name in classifiers or GRIDS
        for i, config in enumerate(combinations(GRIDS[name]))
        for key, value in config.items()
    ]
    return spark.createDataFrame(
        rows, "classifier string, config_id int, name string, value string"
    )
