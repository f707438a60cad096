"""Sample entropy of the variables inside each window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.ordering import ORDER, positions
from faultline.operators.windows import assign_windows
from faultline.schema import RECORDING, VARIABLES


def _matches(x: np.ndarray, rows: int, length: int, others: int, r: float) -> int:
    """Pairs of templates within `r` in every place, without the self matches."""
    close = np.ones((rows, others), dtype=bool)
    for t in range(length):
        close &= np.abs(x[t : t + rows, None] - x[None, t : t + others]) <= r
    return int(close.sum()) - rows


def _template_matches(m: int, r: float):
    """Arrow function counting matches of lengths m and m + 1 in the values of one window."""

    @F.pandas_udf("b long, a long")
    def count(values: pd.Series) -> pd.DataFrame:
        counts = []
        for x in values:
            rows = len(x) - m
            if rows < 1:
                counts.append((0, 0))
                continue
            counts.append(
                (_matches(x, rows, m, rows + 1, r), _matches(x, rows, m + 1, rows, r))
            )
        return pd.DataFrame(counts, columns=["b", "a"])

    return count


def entropy(a: Column, b: Column) -> Column:
    """-ln(a / b); absent where a template of either length never repeats."""
    return F.when((a > 0) & (b > 0), -F.ln(a / b))


def sample_entropy(
    readings: DataFrame,
    size: int,
    step: int,
    m: int,
    tolerance: dict[str, float],
    variables: list[str] = VARIABLES,
    order: list[str] = ORDER,
) -> DataFrame:
    """Per window and variable, `{v}_b`, `{v}_a` (matches of length m, m + 1) and `{v}_entropy`.

    A window's values, `size` at most, travel as one array; no pairs are ever rows.
    """
    placed = positions(readings.select(*RECORDING, *order, *variables), RECORDING, order)
    windows = (
        assign_windows(placed, size, step)
        .groupBy(*RECORDING, "w")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *variables))).alias("rows"))
    )
    counted = windows.select(
        *RECORDING,
        "w",
        *(_template_matches(m, tolerance[v])(F.col("rows")[v]).alias(v) for v in variables),
    )
    columns = []
    for v in variables:
        a, b = F.col(v)["a"], F.col(v)["b"]
        columns += [b.alias(f"{v}_b"), a.alias(f"{v}_a"), entropy(a, b).alias(f"{v}_entropy")]
    return counted.select(*RECORDING, "w", *columns)
