"""Fold properties: disjoint, exhaustive, even; wells and recordings never on both sides."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultline.operators import folds
from faultline.plans import queries, workflow
from faultline.plans.scenarios import SCENARIOS, Job
from faultline.schema import TEST_WELLS, WINDOW
from faultline.session import stage


@pytest.fixture(scope="module")
def made(spark, folder):
    return queries._labelled_windows(spark, folder, "1b").cache()


@pytest.mark.parametrize("k", [2, 5, 7])
def test_shuffled_folds_are_even_and_exhaustive(made, k):
    drawn = folds.kfold_shuffled(made, k, rounds=2).toPandas()
    assert len(drawn) == 2 * made.count()
    assert not drawn.duplicated(["round", *WINDOW]).any()
    sizes = drawn.groupby(["round", "label", "fold"]).size()
    for _, part in sizes.groupby(level=["round", "label"]):
        assert len(part) == k and part.max() - part.min() <= 1
    first, second = (drawn[drawn["round"] == r].sort_values(WINDOW)["fold"] for r in (1, 2))
    assert (first.to_numpy() != second.to_numpy()).any()


def test_assignment_does_not_depend_on_partitions(spark, made):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = folds.kfold_shuffled(made, 5).toPandas().sort_values(WINDOW).reset_index(drop=True)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        got = folds.kfold_shuffled(made.repartition(5), 5).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = got.sort_values(WINDOW).reset_index(drop=True)
    pd.testing.assert_frame_equal(want, got[want.columns])


def test_fewer_rows_than_folds(made):
    few = made.where("label = 1").orderBy(*WINDOW).limit(3)
    drawn = folds.kfold_shuffled(few, 5).toPandas()
    assert sorted(drawn["fold"]) == [0, 1, 2]


def test_wells_stay_on_one_side(made):
    both = folds.expand_folds(folds.leave_one_well_out(made), len(TEST_WELLS))
    sides = both.groupBy("fold", "well_id").agg(F.collect_set("split").alias("s")).collect()
    for row in sides:
        assert row.s == (["valid"] if row.well_id == TEST_WELLS[row.fold] else ["train"])


def test_recordings_stay_on_one_side(spark, folder, made):
    recordings = made.groupBy("class_id", "instance_id", "label").count()
    drawn = folds.kfold_recordings(recordings, 4).toPandas()
    for _, part in drawn.groupby("label"):
        assert (part["fold"].value_counts() == len(part) // 4).all()
        assert part["fold"].isna().sum() == len(part) % 4


def test_missing_well_is_reported_empty(made):
    drawn = folds.leave_one_well_out(made, [1, 99])
    health = {r.fold: r for r in folds.fold_health(drawn, 2).collect()}
    assert health[1].empty_test and health[1].test_neg == 0 and not health[0].empty_test


def test_skipped_wells_are_in_no_fold(spark, folder):
    job = Job(size=20, step=20, skip_wells=(3, 6))
    features = stage(workflow.features_of(queries._clean(spark, folder), job))
    folded = workflow.folds_of(features, SCENARIOS["1a"], job)
    held = workflow.holdout_of(features, SCENARIOS["1a"], job)
    assert folded.where(F.col("well_id").isin(3, 6)).count() == 0
    assert held.where(~F.col("well_id").isin(3, 6)).count() == 0 and held.count() > 0
