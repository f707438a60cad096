"""Whole runs: readings to features to folds to predictions to results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone
from functools import cached_property, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.functions import names
from faultline.models import adaboost, bayes, discriminant, grid, mllib, neighbours, trees, zero_rule
from faultline.operators import clean, folds, metrics, ordering, report, windows
from faultline.operators.moments import fold_moments, train_moments
from faultline.operators.scaling import scaler_fit, scaler_from, standardize
from faultline.plans.scenarios import Job, Scenario
from faultline.schema import TEST_WELLS, WINDOW
from faultline.session import stage
from faultline.sources import recordings, tables

BY = ["case", "round"]
FOLD = [*BY, "fold"]


def clean_readings(readings: DataFrame, variables: list[str]) -> DataFrame:
    return clean.drop_incomplete(readings, variables)


def clean_table(readings: DataFrame, variables: list[str], real_only: bool = False) -> DataFrame:
    """Complete readings with `pos` and `n_rows`; write it once, and windows need no ordering again.

    `real_only` leaves out recordings whose name is not that of a real well.
    """
    if real_only:
        readings = readings.where(names.is_real(F.col("instance_id")))
    return ordering.positions(clean_readings(readings, variables))


def features_of(readings: DataFrame, job: Job) -> DataFrame:
    return windows.window_features(readings, job.size, job.step, list(job.variables))


def folds_of(features: DataFrame, scenario: Scenario, job: Job) -> DataFrame:
    """Labelled windows of the scenario with `case`, `round` and `fold`; skipped wells are left out."""
    labelled = clean.labelled(features, scenario.positive, scenario.negative)
    if job.skip_wells:
        routed = folds.skip_wells(labelled, list(job.skip_wells))
        labelled = routed.where(F.col("split") == "train").drop("split")
    return scenario.fold_rule(labelled, job, scenario).withColumn("case", F.lit(scenario.case))


def holdout_of(features: DataFrame, scenario: Scenario, job: Job) -> DataFrame:
    """Windows of skipped wells, once per (case, round, fold), for that fold's models to score."""
    labelled = clean.labelled(features, scenario.positive, scenario.negative)
    routed = folds.skip_wells(labelled, list(job.skip_wells)).where(F.col("split") == "test")
    each = F.explode(F.sequence(F.lit(0), F.lit(scenario.folds(job) - 1)))
    return (
        folds.with_rounds(routed, job.rounds)
        .withColumn("fold", each)
        .withColumn("case", F.lit(scenario.case))
    )


def concat_well_folds(
    readings: DataFrame, scenario: Scenario, job: Job, wells: list[int] = TEST_WELLS
) -> DataFrame:
    """Leave-one-well-out windows over recordings laid end to end, anew per fold and side."""
    labelled = clean.labelled(readings, scenario.positive, scenario.negative)

    def expand(recordings: DataFrame) -> DataFrame:
        return folds.expand_folds(folds.leave_one_well_out(recordings, wells), len(wells))

    return windows.window_features_concat(
        labelled,
        job.size,
        job.step,
        ["fold", "split", "label"],
        ["label", "well_id"],
        expand,
        list(job.variables),
    )


def scaled_sides(masked: DataFrame, features: list[str], k: int) -> DataFrame:
    """Training and validation rows of every fold, standardised on that fold's training side."""
    scaler = scaler_fit(masked, features, k, BY)
    return standardize(folds.expand_folds(masked, k), scaler, features, FOLD)


Predict = Callable[..., DataFrame]


class Folds:
    """The masked fold table of one or more scenarios, and what classifiers share of it.

    `rows` holds a window once per (case, round) with the fold validating it. The scaled sides
    repeat windows per fold and are built, and staged, only when a classifier asks for them.
    `limits` gives a case's number of folds where it is not `job.k`.
    """

    def __init__(
        self,
        folded: DataFrame,
        features: list[str],
        job: Job,
        holdout: DataFrame | None = None,
        limits: dict[str, int] | None = None,
    ):
        self.features, self.job = features, job
        self.limits = limits or {}
        self.k = max([*self.limits.values()] or [job.k])
        self.rows = stage(clean.mask_nonfinite(folded, features))
        self.holdout = None if holdout is None else clean.mask_nonfinite(holdout, features)
        self._sides: DataFrame | None = None
        self._binned: DataFrame | None = None

    @property
    def valid(self) -> DataFrame:
        """Rows to predict: validation rows, and hold-out rows once per fold."""
        own = self.rows.where(F.col("fold").isNotNull()).select(
            *FOLD, *WINDOW, "label", *self.features, F.lit("valid").alias("split")
        )
        if self.holdout is None:
            return own
        held = self.holdout.select(
            *FOLD, *WINDOW, "label", *self.features, F.lit("test").alias("split")
        )
        return own.unionByName(held)

    @property
    def sides(self) -> DataFrame:
        if self._sides is None:
            narrow = self.rows.select(*FOLD, *WINDOW, "label", *self.features)
            both = folds.expand_folds(narrow, self.k).where(F.col("fold") < self.limit())
            if self.holdout is not None:
                both = both.unionByName(
                    self.holdout.select(*FOLD, *WINDOW, "label", *self.features).withColumn(
                        "split", F.lit("test")
                    )
                )
            scaler = scaler_from(train_moments(self.moments, self.k, BY))
            self._sides = stage(standardize(both, scaler, self.features, FOLD))
        return self._sides

    @cached_property
    def _unbinned(self) -> DataFrame:
        columns = [*FOLD, *WINDOW, "label", *self.features]
        rows = self.rows.select(*columns, F.lit("own").alias("split"))
        if self.holdout is None:
            return rows
        return rows.unionByName(self.holdout.select(*columns, F.lit("test").alias("split")))

    @cached_property
    def bin_tops(self) -> np.ndarray:
        """The greatest values of the bins of `binned`."""
        return trees.bin_tops(self._unbinned, self.features)

    @property
    def binned(self) -> DataFrame:
        """Rows of every fold and side for the tree models: binned once, copied per fold only as they are read."""
        if self._binned is None:
            self._binned = trees.binned(self._unbinned, self.features, ["round", *WINDOW], self.bin_tops)
        own = folds.expand_folds(self._binned.where(F.col("split") == "own").drop("split"), self.k)
        own = own.where(F.col("fold") < self.limit())
        return own if self.holdout is None else own.unionByName(self._binned.where(F.col("split") == "test"))

    @cached_property
    def moments(self) -> DataFrame:
        """Moments of the rows, a few numbers per fold and feature: what scaler and naive Bayes start from."""
        return stage(fold_moments(self.rows, self.features, BY))

    @cached_property
    def drawn(self) -> list[tuple]:
        """Every (case, round, fold)."""
        found = self.rows.select(*BY).distinct().collect()
        return sorted((c, r, f) for c, r in found for f in range(self.limits.get(c, self.k)))

    def cells(self) -> list[tuple]:
        return self.drawn

    def limit(self) -> Column:
        """How many folds the row's case has."""
        return reduce(
            lambda other, case: F.when(F.col("case") == case, self.limits[case]).otherwise(other),
            self.limits,
            F.lit(self.k),
        )


KEYS = ["split", *WINDOW]


def _fitted(data: Folds, fit: Callable[[], DataFrame], predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Predictions of a model that one job fits for all folds; it is staged, and `train_seconds` is a fold's share
    of the job's time."""
    began = time.monotonic()
    model = stage(fit())
    spent = (time.monotonic() - began) / max(1, len(data.drawn))
    return predict(model).withColumn("train_seconds", F.lit(spent))


def _zero_rule(data: Folds, config: dict) -> DataFrame:
    return _fitted(
        data, lambda: zero_rule.fit(data.rows, data.k, BY), lambda model: zero_rule.predict(data.valid, model, KEYS, BY)
    )


def _bayes(data: Folds, config: dict) -> DataFrame:
    return _fitted(
        data,
        lambda: bayes.fit(data.rows, data.features, data.k, BY, data.moments),
        lambda model: bayes.predict(data.valid, model, data.features, KEYS, BY),
    )


def _linear(data: Folds, config: dict) -> DataFrame:
    return _fitted(
        data,
        lambda: discriminant.fit_linear(data.rows, data.features, data.k, BY),
        lambda model: discriminant.predict_linear(data.valid, model, data.features, KEYS, BY),
    )


def _quadratic(data: Folds, config: dict) -> DataFrame:
    return _fitted(
        data,
        lambda: discriminant.fit_quadratic(data.rows, data.features, data.k, BY),
        lambda model: discriminant.predict_quadratic(data.valid, model, data.features, KEYS, BY),
    )


def near(data: Folds, k: int) -> DataFrame:
    train = data.sides.where(F.col("split") == "train")
    query = data.sides.where(F.col("split") != "train")
    return neighbours.nearest(train, query, data.features, KEYS, k, FOLD)


def _unfitted(found: DataFrame) -> DataFrame:
    """Neighbours keep the training side as it is: fitting takes no time."""
    return found.withColumn("train_seconds", F.lit(0.0))


def _nearest(k: int) -> Predict:
    return lambda data, config: _unfitted(neighbours.vote_distance(near(data, k), k, KEYS, FOLD))


def _nearest_uniform(data: Folds, config: dict) -> DataFrame:
    k = config["n_neighbors"]
    return _unfitted(neighbours.vote_uniform(near(data, k), [k], KEYS, FOLD).drop("config", "k"))


def _library(name: str) -> Predict:
    return lambda data, config: mllib.fit_predict(
        name, config, data.sides, data.features, WINDOW, data.cells(), FOLD
    )


def _trees(name: str) -> Predict:
    def run(data: Folds, config: dict) -> DataFrame:
        if name == "GBOOST" and not trees.boosts(data.binned, FOLD):
            return _library(name)(data, config)
        return trees.fit_predict(data.binned, WINDOW, trees.settings(name, config, len(data.features), data.bin_tops), FOLD)

    return run


def _boosted(data: Folds, config: dict) -> DataFrame:
    """All folds are boosted together: `train_seconds` is a fold's share."""
    sides, began = data.sides, time.monotonic()
    found = adaboost.fit_predict(sides, data.features, WINDOW, config["n_estimators"], FOLD)
    return found.withColumn("train_seconds", F.lit((time.monotonic() - began) / max(1, len(data.drawn))))


# Classifier name -> function of the fold data and a configuration. Add your own here.
CLASSIFIERS: dict[str, Predict] = {
    "ZERORULE": _zero_rule,
    "1NN": _nearest(1),
    "3NN": _nearest(3),
    "5NN": _nearest(5),
    "KNN": _nearest_uniform,
    "GNB": _bayes,
    "LDA": _linear,
    "QDA": _quadratic,
    "DT": _trees("DT"),
    "RF": _trees("RF"),
    "GBOOST": _trees("GBOOST"),
    "MLP": _library("MLP"),
    "SVM": _library("SVM"),
    "ADA": _boosted,
}

#: Grown by `trees`, on binned rows.
TREES = ("DT", "RF", "GBOOST")

PREDICTION = [*FOLD, "split", *WINDOW, "y", "p"]


def settings_of(job: Job, classifier: str, config: dict | None = None) -> dict:
    return grid.DEFAULTS.get(classifier, {}) | job.configs.get(classifier, {}) | (config or {})


def predictions(data: Folds, classifier: str, config: dict | None = None) -> DataFrame:
    return CLASSIFIERS[classifier](data, settings_of(data.job, classifier, config))


def config_texts(job: Job) -> Column:
    """The settings of a result row as JSON text, by its classifier and configuration number."""
    texts = {}
    for classifier in job.classifiers:
        configs = grid.configurations(classifier) if job.grid_search else [{}]
        for at, config in enumerate(configs):
            searched = job.grid_search and len(configs) > 1
            settings = grid.DEFAULTS.get(classifier, {}) | config if searched else settings_of(job, classifier, config)
            texts[f"{classifier}:{at}"] = json.dumps(settings, sort_keys=True)
    found = F.map_from_arrays(F.lit(list(texts)), F.lit(list(texts.values())))
    return F.try_element_at(found, F.concat_ws(":", "classifier", "config"))


def _inner_folds(data: Folds, inner: int) -> DataFrame:
    return folds.inner_folds(data.rows.select(*FOLD, *WINDOW, "label", *data.features), data.k, inner)


def inner_tables(data: Folds, inner: int = 4) -> DataFrame:
    """The outer training sides, scaled, cut into inner folds: (case, round, fold, inner, ...)."""
    by_fold = _inner_folds(data, inner)
    scaler = scaler_fit(data.rows, data.features, data.k, BY)
    return standardize(by_fold, scaler, data.features)


def search_neighbours(data: Folds, ks: list[int], inner: int = 4) -> DataFrame:
    """Mean inner macro-F1 of every k, per (case, round, fold): one neighbour pass serves all k."""
    cut = folds.expand_folds(stage(inner_tables(data, inner)), inner, "inner")
    by = [*FOLD, "inner"]
    found = neighbours.nearest(
        cut.where(F.col("split") == "train"),
        cut.where(F.col("split") == "valid"),
        data.features,
        WINDOW,
        max(ks),
        by,
    )
    voted = neighbours.vote_uniform(found, ks, WINDOW, by)
    return report.grid_summary(metrics.scores(voted, [*by, "config"]), FOLD)


def search_library(
    data: Folds, classifier: str, configs: list[dict], inner: int = 4
) -> DataFrame:
    """The same for a library model or boosting: configurations and inner folds in a loop."""
    by = [*FOLD, "inner"]
    if classifier in TREES:
        rows = _inner_folds(data, inner)
        tops = trees.bin_tops(rows, data.features)
        cut = folds.expand_folds(trees.binned(rows, data.features, ["round", *WINDOW], tops), inner, "inner")
    else:
        cut = stage(folds.expand_folds(inner_tables(data, inner), inner, "inner"))
    cells = [(*c, i) for c in data.cells() for i in range(inner)]
    parts = []
    for at, config in enumerate(configs):
        settings = grid.DEFAULTS.get(classifier, {}) | config
        if classifier in TREES:
            choice = trees.settings(classifier, settings, len(data.features), tops)
            found = trees.fit_predict(cut, WINDOW, choice, by)
        elif classifier == "ADA":
            found = adaboost.fit_predict(cut, data.features, WINDOW, settings["n_estimators"], by)
        else:
            found = mllib.fit_predict(classifier, settings, cut, data.features, WINDOW, cells, by)
        scored = metrics.scores(found, by).withColumn("config", F.lit(at))
        parts.append(scored)
    return report.grid_summary(reduce(lambda a, b: a.unionByName(b), parts), FOLD)


def searched_predictions(data: Folds, classifier: str) -> DataFrame:
    """Predictions under each fold's best configuration, with its number in `config`.

    A classifier without a grid runs on its defaults, as configuration 0.
    """
    configs = grid.configurations(classifier)
    if len(configs) < 2:
        return predictions(data, classifier, configs[0]).withColumn("config", F.lit(0))
    if classifier == "KNN":
        ks = [c["n_neighbors"] for c in configs]
        best = report.best_config(stage(search_neighbours(data, ks)), FOLD)
        voted = neighbours.vote_uniform(near(data, max(ks)), ks, KEYS, FOLD).drop("k")
        return voted.join(F.broadcast(best.select(*FOLD, "config")), [*FOLD, "config"])
    best = report.best_config(search_library(data, classifier, configs), FOLD).collect()
    parts = []
    for row in best:
        cell = tuple(row[c] for c in FOLD)
        here = reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(FOLD, cell)))
        settings = grid.DEFAULTS.get(classifier, {}) | configs[row["config"]]
        own = (data.binned if classifier in TREES else data.sides).where(here)
        if classifier in TREES:
            choice = trees.settings(classifier, settings, len(data.features), data.bin_tops)
            found = trees.fit_predict(own, WINDOW, choice, FOLD)
        elif classifier == "ADA":
            began = time.monotonic()
            found = adaboost.fit_predict(own, data.features, WINDOW, settings["n_estimators"], FOLD)
            found = found.withColumn("train_seconds", F.lit(time.monotonic() - began))
        else:
            found = mllib.fit_predict(classifier, settings, own, data.features, WINDOW, [cell], FOLD)
        kept = [*PREDICTION, "train_seconds"] if "train_seconds" in found.columns else PREDICTION
        parts.append(found.select(*kept).withColumn("config", F.lit(row["config"])))
    return reduce(lambda a, b: a.unionByName(b), parts)


def score(found: DataFrame, classifier: str) -> DataFrame:
    """Scores per (case, round, fold) and side; hold-out rows are scored apart."""
    if "config" not in found.columns:
        found = found.withColumn("config", F.lit(0))
    if "train_seconds" not in found.columns:
        found = found.withColumn("train_seconds", F.lit(None).cast("double"))
    by = [*FOLD, "split", "config", "train_seconds"]
    return metrics.scores(found, by).withColumn("classifier", F.lit(classifier))


def experiment_results(features: DataFrame, scenarios: list[Scenario], job: Job) -> DataFrame:
    """Result rows of every (case, classifier, round, fold), and of the hold-out wells if any.

    Row counts of the sides are taken before the mask, scores after it. Every fold has its row: where
    its validation side holds no scored row, or its training side none, scores are NULL; `empty_test`
    says that a label is missing from the validation side, `empty_train` from the training side.
    Hold-out rows carry fold -1 and the number of the fold whose model scored them in `model_fold`.
    `seed` is the round's, `timestamp` the start of the run, `config_text` the classifier's settings.
    """
    began = F.lit(datetime.now(timezone.utc).isoformat(timespec="seconds")).cast("timestamp")
    columns = windows.feature_names(list(job.variables))

    def every(make: Callable[..., DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), (make(features, s, job) for s in scenarios))

    folded = stage(every(folds_of))
    holdout = every(holdout_of) if job.skip_wells else None
    data = Folds(folded, columns, job, holdout, {s.case: s.folds(job) for s in scenarios})
    health = folds.fold_health(folded, data.k, BY).drop("more_positives")
    health = health.where(F.col("fold") < data.limit()).withColumn(
        "empty_train", (F.col("train_neg") == 0) | (F.col("train_pos") == 0)
    )
    parts = []
    for classifier in job.classifiers:
        found = (
            searched_predictions(data, classifier)
            if job.grid_search
            else predictions(data, classifier)
        )
        parts.append(score(found, classifier))
    scored = reduce(lambda a, b: a.unionByName(b), parts)
    sides = ["valid"] if holdout is None else ["valid", "test"]
    due = health.withColumn("classifier", F.explode(F.lit(list(job.classifiers)))).withColumn(
        "split", F.explode(F.lit(sides))
    )
    sized = due.join(scored, [*FOLD, "classifier", "split"], "left").withColumn(
        "config", F.coalesce("config", F.lit(0))
    )
    held = F.col("split") == "test"
    total_neg = F.col("tn") + F.col("fp")
    total_pos = F.col("tp") + F.col("fn")
    return sized.select(
        F.concat(F.lit("experiment"), F.col("case")).alias("experiment"),
        "case",
        "round",
        F.when(held, -1).otherwise(F.col("fold")).alias("fold"),
        F.col("fold").alias("model_fold"),
        "classifier",
        "config",
        "f1binp",
        "f1binn",
        "f1micro",
        "f1macro",
        "f1weighted",
        "precision",
        "recall",
        "accuracy",
        "train_seconds",
        "train_neg",
        "train_pos",
        F.when(held, total_neg).otherwise(F.col("test_neg")).alias("test_neg"),
        F.when(held, total_pos).otherwise(F.col("test_pos")).alias("test_pos"),
        "pred_neg",
        "pred_pos",
        "tp",
        "tn",
        "fp",
        "fn",
        "empty_test",
        "empty_train",
        F.col("round").alias("seed"),
        began.alias("timestamp"),
        config_texts(job).alias("config_text"),
    )


def run(spark: SparkSession, root: str, out: str, scenarios: list[Scenario], job: Job) -> DataFrame:
    """A whole run from a tree of CSV files: typed and cleaned recordings, features, folds and results are tables
    below `out`, each written before the next reads it, so a part can be run again from what is there."""
    tables.write_partitioned(recordings.scan_csv(spark, root), f"{out}/recordings", ["class_id"])
    readings = spark.read.parquet(f"{out}/recordings")
    tables.write_partitioned(clean_table(readings, list(job.variables), real_only=True), f"{out}/clean", ["class_id"])
    clean_rows = spark.read.parquet(f"{out}/clean")
    tables.write_partitioned(features_of(clean_rows, job), f"{out}/features", ["class_id"])
    features = spark.read.parquet(f"{out}/features")
    for scenario in scenarios:
        tables.write_partitioned(folds_of(features, scenario, job), f"{out}/folds", ["case", "round"])
    results = experiment_results(features, scenarios, job)
    tables.write_partitioned(results, f"{out}/results", ["case"])
    return spark.read.parquet(f"{out}/results")
