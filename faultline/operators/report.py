"""Summaries of results: pivots by case, merged files, grid searches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from faultline.functions import names

CASES = ["a", "b"]


def pivot_report(results: DataFrame, cases: list[str] = CASES) -> DataFrame:
    """(classifier, e) by case: mean and deviation of macro-F1, largest test sides, row count.

    The cases are named, so the pivot needs no pass to find them.
    """
    named = results.withColumns(
        {
            "e": names.experiment_stem(F.col("experiment")),
            "case": names.experiment_case(F.col("experiment")),
        }
    )
    return (
        named.groupBy("classifier", "e")
        .pivot("case", cases)
        .agg(
            F.avg("f1macro").alias("f1macro_mean"),
            F.stddev_samp("f1macro").alias("f1macro_std"),
            F.max("test_neg").alias("test_neg_max"),
            F.max("test_pos").alias("test_pos_max"),
            F.count("f1macro").alias("n"),
        )
    )


def outer_results(results: DataFrame) -> DataFrame:
    return results.where(F.col("fold") >= 0)


def holdout_results(results: DataFrame) -> DataFrame:
    return results.where(F.col("fold") < 0)


def round_results(results: DataFrame, round_: int = 1) -> DataFrame:
    return outer_results(results).where(F.col("round") == round_)


def merge_results(*results: DataFrame) -> DataFrame:
    """Stack result tables; derive the case and scenario letters from the experiment name."""
    stacked = reduce(lambda a, b: a.unionByName(b), results)
    x = F.col("experiment")
    return stacked.withColumns(
        {
            "case": names.experiment_group(x),
            "scenario": names.experiment_case(x),
            "welltest": F.lit(0),
        }
    )


def grid_summary(inner_scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean inner score per configuration."""
    return inner_scores.groupBy(*by, "config").agg(F.avg("f1macro").alias("mean_f1macro"))


def best_config(summary: DataFrame, by: list[str]) -> DataFrame:
    """The configuration with the best mean; the first in order among equals."""
    order = Window.partitionBy(*by).orderBy(F.desc("mean_f1macro"), "config")
    return summary.withColumn("at", F.row_number().over(order)).where("at = 1").drop("at")
