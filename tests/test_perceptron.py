"""The perceptron's training against the fits of Spark's ML library."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from faultline.models import mllib, perceptron
from faultline.session import stage

FEATURES, BY, CELLS = ["a", "b", "c"], ["round", "fold"], [(0, 0), (0, 1), (1, 0)]
CONFIG = {"hidden_layer_sizes": 5, "solver": "lbfgs", "max_iter": 25}


@pytest.fixture(scope="module")
def sides(spark):
    """Three cells of about 400 training rows in partitions that end inside a stack; rows repeat."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1800, 3)).round(2)
    y = (x[:, 0] * x[:, 1] + rng.normal(size=len(x)) / 2 > 0).astype(int)
    rows = [
        (*CELLS[i % 3], "valid" if i % 4 == 0 else "train", i // 2, int(y[i]), *map(float, x[i])) for i in range(len(x))
    ]
    schema = "round int, fold int, split string, key int, label int, a double, b double, c double"
    return stage(spark.createDataFrame(rows + rows[:7], schema).repartition(3))


def plain(sides, cell, config=CONFIG):
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(sides.withColumn("label", F.col("label").cast("double")))
    train = rows.where(mllib._is(BY, cell) & (F.col("split") == "train")).select("x", "label")
    return mllib.estimator("MLP", config, len(FEATURES), 0, cell[0]).fit(train)


def test_same_weights_as_a_fit_per_fold(sides):
    models, _ = mllib._perceptrons(CONFIG, sides, FEATURES, CELLS, BY)
    for cell in CELLS:
        np.testing.assert_allclose(models[cell].weights.toArray(), plain(sides, cell).weights.toArray(), rtol=1e-5, atol=1e-7)


def test_blocks_and_tasks_change_nothing(sides, monkeypatch):
    want, _ = mllib._perceptrons(CONFIG, sides, FEATURES, CELLS, BY)
    for name, value in {"BLOCK_ROWS": 128, "RUN_ROWS": 128, "TASK_ROWS": 100}.items():
        monkeypatch.setattr(perceptron, name, value)
    got, _ = mllib._perceptrons(CONFIG, sides, FEATURES, CELLS, BY)
    for cell in CELLS:
        np.testing.assert_allclose(got[cell].weights.toArray(), want[cell].weights.toArray(), rtol=1e-5, atol=1e-7)


def test_one_job_a_pass_for_all_folds(sides, monkeypatch):
    """The library gets two rows to hold weights, never the training rows; a pass asks for all folds at once."""
    seen, asked = [], []
    fit, one = MultilayerPerceptronClassifier.fit, perceptron._pass
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, rows: seen.append(rows.count()) or fit(self, rows))
    monkeypatch.setattr(perceptron, "_pass", lambda held, points, hidden: asked.append(len(points)) or one(held, points, hidden))
    found = mllib.fit_predict("MLP", CONFIG, sides, FEATURES, ["key"], CELLS, BY)
    got = sorted(map(tuple, found.drop("train_seconds").collect()))
    assert set(seen) == {2} and asked[:20] == [3] * 20 and len(asked) < 60
    monkeypatch.undo()
    monkeypatch.setattr(mllib, "_perceptrons", lambda *_: ({}, 0.0))
    old = mllib.fit_predict("MLP", CONFIG, sides, FEATURES, ["key"], CELLS, BY)
    assert got == sorted(map(tuple, old.drop("train_seconds").collect())) and len(got) > 400


def test_a_search_ends_as_the_library_does(sides):
    """Flat objectives, and a fold whose rows all have one label."""
    one = sides.withColumn("label", F.lit(1))
    steps = CONFIG | {"max_iter": 200}
    models, _ = mllib._perceptrons(steps, one, FEATURES, CELLS[:1], BY)
    old = plain(one, CELLS[0], steps)
    np.testing.assert_allclose(models[CELLS[0]].weights.toArray(), old.weights.toArray(), rtol=1e-4, atol=1e-6)


def test_cells_without_training_rows_and_rows_that_are_not_numbers(sides):
    models, _ = mllib._perceptrons(CONFIG, sides, FEATURES, [*CELLS, (7, 7)], BY)
    assert set(models) == set(CELLS)
    with pytest.raises(Exception, match="not finite"):
        mllib._perceptrons(CONFIG, sides.withColumn("b", F.lit(None).cast("double")), FEATURES, CELLS, BY)
