"""Row-level preparation: missing values, labels, audits and masks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from faultline.schema import FLOAT32_MAX, VARIABLES


def nan_to_null(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fold NaN into NULL once, at ingest; every later operator knows NULL only."""
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def drop_incomplete(df: DataFrame, variables: list[str] = VARIABLES) -> DataFrame:
    """Keep rows where every used variable is present; plain null tests reach the scan."""
    return df.where(reduce(lambda a, b: a & b, (F.col(v).isNotNull() for v in variables)))


def labelled(df: DataFrame, positive: list[int], negative: list[int]) -> DataFrame:
    """Keep the rows of both groups, labelled 1 and 0 by class membership."""
    label = F.when(F.col("class_id").isin(positive), 1).otherwise(0)
    return df.where(F.col("class_id").isin(positive + negative)).withColumn("label", label)


def union_labelled(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Stack two groups, labelling them 0 and 1."""
    return negative.withColumn("label", F.lit(0)).unionByName(
        positive.withColumn("label", F.lit(1))
    )


def cast_float(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("float") for c in columns})


def _unusable(x: Column) -> Column:
    return (
        x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x > F.lit(FLOAT32_MAX))
    )


def nonfinite(columns: list[str]) -> Column:
    """True where any column is missing, infinite or above the largest 32-bit float."""
    return reduce(lambda a, b: a | b, (_unusable(F.col(c)) for c in columns))


def mask_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(~nonfinite(columns))


def flag_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("bad", nonfinite(columns))


def quality_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count bad cells by kind, in one pass.

    The four kinds are disjoint. `overlapping_total` adds the six overlapping tests of the
    original audit: over the limit, not finite, infinite, and three times missing.
    """

    def cells(test) -> Column:
        return reduce(lambda a, b: a + b, (F.count_if(test(F.col(c))) for c in columns))

    infinite = float("inf")
    counts = df.agg(
        cells(lambda x: x.isNull() | F.isnan(x)).alias("missing"),
        cells(lambda x: x == infinite).alias("plus_infinite"),
        cells(lambda x: x == -infinite).alias("minus_infinite"),
        cells(
            lambda x: (x > F.lit(FLOAT32_MAX)) & (x < infinite) & ~F.isnan(x)
        ).alias("over_float32"),
        (F.count(F.lit(1)) * len(columns)).alias("cells"),
    )
    c = F.col
    infinities = c("plus_infinite") + c("minus_infinite")
    return counts.withColumn(
        "overlapping_total",
        c("over_float32") + c("plus_infinite") + 2 * infinities + 4 * c("missing"),
    )
