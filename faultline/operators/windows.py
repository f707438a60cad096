"""Row-count windows over recordings and the statistics of each window."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators import pieces
from faultline.operators.ordering import ORDER, exclusive_sum, ordered, pieces as recording_pieces, positions
from faultline.schema import RECORDING, VARIABLES

# Statistic name -> aggregate, in feature order. Pass a longer dict to add your own.
STATISTICS: dict[str, Callable[[str], Column]] = {
    "max": F.max,
    "mean": F.avg,
    "median": lambda v: F.percentile(v, F.lit(0.5)),
    "min": F.min,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


def feature_names(variables: list[str] = VARIABLES, statistics=STATISTICS) -> list[str]:
    return [f"{v}_{s}" for v in variables for s in statistics]


def window_count(n: Column, size: int, step: int, drop_last: bool = True) -> Column:
    """Windows in `n` rows, at least one.

    `drop_last` leaves out the last full window, the count results are compared under; without
    it every full window counts.
    """
    whole = F.floor((n - size) / step) + (0 if drop_last else 1)
    return F.greatest(whole, F.lit(1))


def assign_windows(
    df: DataFrame, size: int, step: int, pos: str = "pos", n: str = "n_rows", drop_last: bool = True
) -> DataFrame:
    """One row per (row, window holding it), the window numbered `w`.

    Steps of at least the window size give each row at most one window and need no explode.
    """
    p = F.col(pos)
    last = window_count(F.col(n), size, step, drop_last) - 1
    if step >= size:
        w = F.floor(p / step)
        return df.withColumn("w", w).where((F.col("w") <= last) & (p - w * step < size))
    first = F.greatest(F.ceil((p - size + 1) / step), F.lit(0))
    until = F.least(F.floor(p / step), last)
    return (
        df.withColumns({"first": first, "until": until})
        .where(F.col("first") <= F.col("until"))
        .withColumn("w", F.explode(F.sequence("first", "until")))
        .drop("first", "until")
    )


def summarise(
    df: DataFrame,
    by: list[str],
    variables: list[str] = VARIABLES,
    statistics=STATISTICS,
    missing: bool = True,
) -> DataFrame:
    """Statistics of every variable per group, in one shuffle of the values (medians need them all).

    With `missing`, a window with an absent value of a variable has no statistics of it; callers
    that dropped incomplete rows switch the check off.
    """
    columns = []
    for v in variables:
        whole = F.count(v) == F.count(F.lit(1))
        for name, aggregate in statistics.items():
            value = aggregate(v)
            columns.append((F.when(whole, value) if missing else value).alias(f"{v}_{name}"))
    return df.groupBy(*by).agg(*columns)


def window_features(
    readings: DataFrame,
    size: int,
    step: int,
    variables: list[str] = VARIABLES,
    keep: tuple[str, ...] = ("well_id",),
    statistics=STATISTICS,
    order: list[str] = ORDER,
    drop_last: bool = True,
    missing: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Features of windows inside each recording; `keep` names columns fixed per recording.

    Readings are exchanged once, by range, and windows are summarised where their rows lie (`pieces`).
    Readings that carry `pos` and `n_rows` already are used as they are, and statistics other than those of
    `STATISTICS` are left to Spark's aggregates; both move the values of every window to one place.
    """
    if {"pos", "n_rows"} <= set(readings.columns):
        placed = readings.select(*RECORDING, *keep, "pos", "n_rows", *variables)
    elif all(STATISTICS.get(name) is aggregate for name, aggregate in statistics.items()):
        return pieces.window_features(
            readings, size, step, variables, keep, list(statistics), order, drop_last, missing, parts,
            assign_windows, partial(summarise, statistics=statistics),
        )
    else:
        narrow = readings.select(*RECORDING, *keep, *order, *variables)
        placed = positions(narrow, RECORDING, order, parts)
    assigned = assign_windows(placed, size, step, drop_last=drop_last)
    return summarise(assigned, RECORDING + list(keep) + ["w"], variables, statistics, missing)


def concat_positions(
    readings: DataFrame,
    group: list[str],
    fixed: list[str],
    expand: Callable[[DataFrame], DataFrame] = lambda df: df,
    order: list[str] = ORDER,
    parts: int | None = None,
) -> DataFrame:
    """Position of each row in its group's recordings laid end to end, and the group's `n_rows`.

    Recordings follow each other by (class, recording). `fixed` names columns constant per
    recording; `expand` turns a table of recordings with them into one with the `group` columns,
    repeating recordings that belong to several groups. Groups must be few. Rows are shuffled once,
    by range; where a recording goes is worked out on the small table of pieces.
    """
    unit = RECORDING + ["piece"]
    placed = ordered(readings, RECORDING, order, parts)
    firsts = recording_pieces(placed).select(*unit, "first_at")
    units = expand(placed.groupBy(*unit, *fixed).agg(F.count(F.lit(1)).alias("unit_n")))
    starts = exclusive_sum(units, group, unit, "unit_n", "start", "n_rows")
    places = (
        starts.groupBy(*unit)
        .agg(F.collect_list(F.struct(*group, "start", "n_rows")).alias("places"))
        .join(firsts, unit)
    )
    return (
        placed.drop(*fixed)
        .join(places, unit)
        .withColumn("place", F.explode("places"))
        .select("*", "place.*")
        .withColumn("pos", F.col("start") + F.col("at") - F.col("first_at"))
        .drop("places", "place", "start", "at", "first_at", "piece")
    )


def window_features_concat(
    readings: DataFrame,
    size: int,
    step: int,
    group: list[str],
    fixed: list[str] | None = None,
    expand: Callable[[DataFrame], DataFrame] = lambda df: df,
    variables: list[str] = VARIABLES,
    statistics=STATISTICS,
    order: list[str] = ORDER,
    drop_last: bool = True,
    missing: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Features of windows over each group's recordings laid end to end."""
    fixed = group if fixed is None else fixed
    narrow = readings.select(*RECORDING, *fixed, *order, *variables)
    placed = concat_positions(narrow, group, fixed, expand, order, parts)
    assigned = assign_windows(placed, size, step, drop_last=drop_last)
    return summarise(assigned, group + ["w"], variables, statistics, missing)


def select_variables(df: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Keep the feature blocks of the named variables."""
    blocks = [c for c in df.columns if c.rsplit("_", 1)[0] in variables]
    return df.select(*keys, *blocks)


def select_statistics(df: DataFrame, keys: list[str], statistics: list[str]) -> DataFrame:
    """Keep the named statistics of every variable."""
    kept = [c for c in df.columns if c not in keys and c.rsplit("_", 1)[-1] in statistics]
    return df.select(*keys, *kept)
