"""Forward fill of missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from faultline.operators.ordering import ORDER, ordered
from faultline.schema import RECORDING, VARIABLES


def forward_fill(
    readings: DataFrame,
    variables: list[str] = VARIABLES,
    order: list[str] = ORDER,
    parts: int | None = None,
) -> DataFrame:
    """Replace a missing value by the last present one before it in the recording.

    Values are carried inside a piece by a window; between the pieces of a recording the last present
    value of each piece travels through a table of one row per piece.
    """
    placed = ordered(readings, RECORDING, order, parts)
    unit = RECORDING + ["piece"]
    inside = Window.partitionBy(*unit).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    filled = placed.withColumns({v: F.last(v, ignorenulls=True).over(inside) for v in variables})
    last_seen = [
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col("at"))).alias(f"last_{v}") for v in variables
    ]
    earlier = Window.partitionBy(*RECORDING).orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = placed.groupBy(*unit).agg(*last_seen).select(
        *unit,
        *(F.last(f"last_{v}", ignorenulls=True).over(earlier).alias(f"last_{v}") for v in variables),
    )
    return (
        filled.join(carried, unit)
        .withColumns({v: F.coalesce(v, f"last_{v}") for v in variables})
        .drop("piece", "at", *(f"last_{v}" for v in variables))
    )
