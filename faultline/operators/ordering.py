"""Positions, running sums and ranks over a total order, without one task holding a whole group.

Three devices, all exact:

* readings are dealt out once by ranges of (recording, order) and staged sorted, so a recording of any
  length is cut wherever a range ends, within one time stamp too (`ordered`); positions follow from the
  row counts of these pieces (`positions`);
* a running sum over many small units is taken inside order cells and carried between at most a
  few hundred cells (`exclusive_sum`);
* a rank by digest is taken inside digest-prefix cells (`digest_rank`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.schema import RECORDING
from faultline.session import stage

ORDER = ["ts", "seq"]


def ordered(
    df: DataFrame, keys: list[str] = RECORDING, order: list[str] = ORDER, parts: int | None = None
) -> DataFrame:
    """`df` staged in ranges of (keys, order): `piece` numbers the range, `at` grows with the order.

    Range borders are sampled, so ranges are about even however long a recording is.
    """
    spark = df.sparkSession
    if parts is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return stage(sorted_.withColumns({"piece": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))


def pieces(placed: DataFrame, keys: list[str] = RECORDING) -> DataFrame:
    """One row per (keys, piece) of an `ordered` table: its first `at` and its rows, `piece_n`.

    A range cuts at most two recordings, so there are at most two rows more per range than recordings.
    """
    return placed.groupBy(*keys, "piece").agg(
        F.min("at").alias("first_at"), F.count(F.lit(1)).alias("piece_n")
    )


def positions(
    df: DataFrame,
    keys: list[str] = RECORDING,
    order: list[str] = ORDER,
    parts: int | None = None,
) -> DataFrame:
    """Add the 0-based `pos` of a row in its recording and the recording's `n_rows`.

    The rows are shuffled once, by range; the piece counts are then joined to them.
    """
    placed = ordered(df, keys, order, parts)
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces(placed, keys).select(
        *keys,
        "piece",
        (F.coalesce(F.sum("piece_n").over(before), F.lit(0)) - F.col("first_at")).alias("shift"),
        F.sum("piece_n").over(whole).alias("n_rows"),
    )
    return (
        placed.join(starts, [*keys, "piece"])
        .withColumn("pos", F.col("at") + F.col("shift"))
        .drop("piece", "at", "shift")
    )


def exclusive_sum(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value: str,
    out: str,
    total: str | None = None,
    cells: int = 256,
) -> DataFrame:
    """Sum of `value` over the earlier rows of the group, in `order` (unique within the group).

    `total` names a column for the sum over the whole group.

    Cell borders are the order keys with the smallest hashes, a fixed-size even sample, so cells
    hold about equal shares however the keys are spread. `group` must have few distinct values.
    `df`, read three times, is staged; it holds a row per unit, not per reading.
    """
    df = stage(df)
    key = F.struct(*order)
    sample = df.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(cells)
    borders = sample.agg(F.sort_array(F.collect_list("k"))).scalar()
    celled = (
        df.withColumn("borders", borders)
        .withColumn("cell", F.size(F.filter("borders", lambda b: b <= F.struct(*order))))
        .drop("borders")
    )
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "cell").orderBy(*order).rowsBetween(*earlier)
    across = Window.partitionBy(*group).orderBy("cell").rowsBetween(*earlier)
    cell_sums = (
        celled.groupBy(*group, "cell")
        .agg(F.sum(value).alias("cell_sum"))
        .withColumn("carried", F.coalesce(F.sum("cell_sum").over(across), F.lit(0)))
        .withColumn(total or "whole", F.sum("cell_sum").over(Window.partitionBy(*group)))
        .drop("cell_sum", "whole")
    )
    return (
        celled.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(cell_sums), group + ["cell"])
        .withColumn(out, F.col("inside") + F.col("carried"))
        .drop("cell", "inside", "carried")
    )


def digest_rank(
    df: DataFrame, group: list[str], text: Column, tail: list[str], digits: int = 2
) -> DataFrame:
    """Add the 0-based `rank` of a row in its group by md5(`text`), and the group's `group_n`.

    The digest is even whatever the data, so 16**digits prefix cells split any group evenly.
    """
    hashed = df.withColumn("digest", F.md5(text)).withColumn(
        "cell", F.substring("digest", 1, digits)
    )
    inside = Window.partitionBy(*group, "cell").orderBy("digest", *tail)
    whole = Window.partitionBy(*group)
    before = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        hashed.groupBy(*group, "cell")
        .agg(F.count(F.lit(1)).alias("cell_n"))
        .withColumn("before", F.coalesce(F.sum("cell_n").over(before), F.lit(0)))
        .withColumn("group_n", F.sum("cell_n").over(whole))
        .drop("cell_n")
    )
    return (
        hashed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(cells), group + ["cell"])
        .withColumn("rank", F.col("inside") + F.col("before"))
        .drop("digest", "cell", "inside", "before")
    )


def ordered_rank(
    df: DataFrame, group: list[str], order: list[str], block: Column | None = None
) -> DataFrame:
    """Add the 0-based `rank` of a row in its group by `order`, and the group's `group_n`.

    `block`, a function of the last order column that grows with it, bounds how many rows share
    the leading order columns; by default 4096 consecutive whole numbers make one block.
    """
    head, last = order[:-1], order[-1]
    if block is None:
        block = F.floor(F.col(last) / 4096)
    blocked = df.withColumn("block", block)
    units = blocked.groupBy(*group, *head, "block").agg(F.count(F.lit(1)).alias("unit_n"))
    starts = exclusive_sum(units, group, head + ["block"], "unit_n", "start", "group_n")
    inside = Window.partitionBy(*group, *head, "block").orderBy(last)
    return (
        blocked.withColumn("inside", F.row_number().over(inside) - 1)
        .join(starts.drop("unit_n"), group + head + ["block"])
        .withColumn("rank", F.col("start") + F.col("inside"))
        .drop("block", "inside", "start")
    )


def tile(rank: Column, n: Column, k: int) -> Column:
    """Which of `k` runs, sized alike to within one row, larger ones first, holds `rank`."""
    small = F.floor(n / k)
    extra = n % k
    head = extra * (small + 1)
    return (
        F.when(rank < head, F.floor(rank / (small + 1)))
        .otherwise(extra + F.floor((rank - head) / F.nullif(small, F.lit(0))))
        .cast("int")
    )
