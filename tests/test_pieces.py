"""Windows summarised where their rows lie, against windows moved to one place."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import pieces, windows
from faultline.schema import RECORDING

KEYS = [*RECORDING, "well_id", "w"]


@pytest.fixture(scope="module")
def readings(spark):
    """Recordings of 1 to 400 rows, one of them much longer than a range, with absent values and ties in time."""
    rng = np.random.default_rng(8)
    rows = []
    for instance, n in enumerate([1, 3, 19, 20, 21, 25, 40, 400, 60, 7, 33]):
        for i in range(n):
            a, b = rng.normal(size=2)
            rows.append((instance % 3, f"r{instance}", instance, i // 4, i, float(a), None if rng.random() < 0.1 else float(b)))
    rows += [(2, "r11", 99, i, i, float(i), 1.0) for i in range(30)]
    return spark.createDataFrame(rows, "class_id int, instance_id string, well_id int, ts int, seq int, v1 double, v2 double").repartition(5)


def both(readings, size, step, **more):
    """The features, and those of the same readings with their positions worked out first."""
    options = {"variables": ["v1", "v2"], **more}
    ours = windows.window_features(readings, size, step, parts=options.pop("parts", 6), **options)
    placed = windows.positions(readings, parts=3)
    theirs = windows.window_features(placed, size, step, **options)
    return ours, theirs


def frame(df):
    return df.toPandas().sort_values(KEYS, na_position="first").reset_index(drop=True)[sorted(df.columns)]


@pytest.mark.parametrize(
    "size, step, drop_last, missing, parts",
    [(20, 20, True, False, 6), (20, 3, True, True, 9), (7, 10, False, False, 6), (50, 1, False, True, 25)],
)
def test_like_windows_that_are_moved(spark, readings, size, step, drop_last, missing, parts):
    ours, theirs = both(readings, size, step, drop_last=drop_last, missing=missing, parts=parts)
    a, b = frame(ours), frame(theirs)
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    assert a[["class_id", "well_id", "w"]].equals(b[["class_id", "well_id", "w"]])
    for c in set(a.columns) - {*KEYS}:
        x, y = (f[c].astype(float).to_numpy() for f in (a, b))
        other = ~np.isclose(x, y, rtol=1e-9, atol=1e-9, equal_nan=True)
        assert not other.any(), (c, a.loc[other, KEYS], x[other], y[other])


def test_files_may_be_split_anywhere(spark, readings, monkeypatch):
    """Batches of a few rows, and rows of the stage that come in other runs than they were written in."""
    whole = frame(windows.window_features(readings, 10, 4, ["v1"]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    stage = pieces.stage

    def cut(df):
        # Like a file split: runs of the stage are dealt to other tasks, in order.
        out = stage(df)
        return out if "at" not in out.columns else out.repartition(9, "piece", F.floor(F.col("at") / 50)).sortWithinPartitions("piece", "at")

    monkeypatch.setattr(pieces, "stage", cut)
    try:
        split = frame(windows.window_features(readings, 10, 4, ["v1"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert split[["instance_id", "w"]].equals(whole[["instance_id", "w"]])
    features = windows.feature_names(["v1"])
    assert np.allclose(split[features].astype(float), whole[features].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_readings_are_exchanged_once_and_empty_ones_give_none(spark, readings):
    made = windows.window_features(readings, 20, 20, ["v1"])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan
    none = windows.window_features(readings.where("class_id > 5"), 20, 20, ["v1"])
    assert none.collect() == [] and none.columns == made.columns


def test_statistics_of_ones_own_go_the_other_way(readings):
    made = windows.window_features(readings, 20, 20, ["v1"], statistics={**windows.STATISTICS, "sum": F.sum})
    plain = windows.window_features(readings, 20, 20, ["v1"])
    assert made.select(KEYS).exceptAll(plain.select(KEYS)).count() == 0 and "v1_sum" in made.columns
    assert list(itertools.chain(windows.STATISTICS)) == ["max", "mean", "median", "min", "std", "var"]
