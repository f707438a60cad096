"""The four scenarios: which classes count as fault, and how folds are drawn."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from faultline.operators import folds
from faultline.schema import TEST_WELLS


@dataclass(frozen=True)
class Job:
    """What a run needs to know; everything is fixed before it starts.

    `k` counts the folds that are drawn by window; folds by well are one per well of the scenario.
    """

    size: int = 900
    step: int = 900
    k: int = 5
    rounds: int = 1
    shuffle: bool = True
    variables: tuple[str, ...] = ("v1", "v2", "v3", "v4", "v5")
    classifiers: tuple[str, ...] = ("1NN", "RF", "QDA", "LDA", "GNB", "ZERORULE")
    grid_search: bool = False
    skip_wells: tuple[int, ...] = ()
    configs: dict[str, dict] = field(default_factory=dict)


FoldRule = Callable[[DataFrame, Job, "Scenario"], DataFrame]


@dataclass(frozen=True)
class Scenario:
    case: str
    positive: list[int]
    negative: list[int]
    fold_rule: FoldRule
    wells: tuple[int, ...] = ()

    def folds(self, job: Job) -> int:
        return len(self.wells) or job.k


def by_window(windows: DataFrame, job: Job, scenario: Scenario) -> DataFrame:
    if job.shuffle:
        return folds.kfold_shuffled(windows, job.k, job.rounds)
    return folds.with_rounds(folds.kfold_contiguous(windows, job.k), job.rounds)


def by_well(windows: DataFrame, job: Job, scenario: Scenario) -> DataFrame:
    return folds.with_rounds(folds.leave_one_well_out(windows, list(scenario.wells)), job.rounds)


def by_recording(windows: DataFrame, job: Job, scenario: Scenario) -> DataFrame:
    """Folds over whole recordings, a third rule to pass to a scenario of one's own."""
    key = ["class_id", "instance_id"]
    recordings = windows.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("windows"))
    drawn = folds.kfold_recordings(recordings, job.k, job.rounds, job.shuffle)
    if not job.shuffle:
        drawn = folds.with_rounds(drawn, job.rounds)
    return windows.join(drawn.drop("windows", "label"), key)


# Fault class 4 against normal operation, or against every other class.
_OTHERS = [0, 1, 2, 3, 5, 6, 7, 8]
SCENARIOS = {
    "1a": Scenario("1a", [4], [0], by_window),
    "1b": Scenario("1b", [4], _OTHERS, by_window),
    "2a": Scenario("2a", [4], [0], by_well, tuple(TEST_WELLS)),
    "2b": Scenario("2b", [4], _OTHERS, by_well, tuple(TEST_WELLS)),
}
