"""Fold assignment. A row is validated in at most one fold of a round: that fold is a column.

`fold` is NULL for rows that only ever train. Training sides are not copied until an operator
needs them (`expand_folds`); scalers, naive Bayes and discriminants never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.ordering import digest_rank, ordered_rank, tile
from faultline.schema import RECORDING, TEST_WELLS, WINDOW


def with_rounds(df: DataFrame, rounds: int) -> DataFrame:
    """One copy of the rows per round, numbered from 1."""
    return df.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))


def _shuffle_text(keys: list[str]) -> Column:
    """The text whose digest orders a shuffle; the round is its seed."""
    return F.concat_ws("|", "round", *keys)


def kfold_shuffled(
    windows: DataFrame, k: int, rounds: int = 1, group: list[str] = ["label"], keys=WINDOW
) -> DataFrame:
    """Shuffled k-fold over windows, each label on its own, seeded by the round."""
    ranked = digest_rank(
        with_rounds(windows, rounds), ["round", *group], _shuffle_text(keys), list(keys)
    )
    return ranked.withColumn("fold", tile(F.col("rank"), F.col("group_n"), k)).drop(
        "rank", "group_n"
    )


def kfold_contiguous(windows: DataFrame, k: int, group: list[str] = ["label"]) -> DataFrame:
    """k-fold over windows in order, each label on its own."""
    ranked = ordered_rank(windows, group, WINDOW)
    return ranked.withColumn("fold", tile(F.col("rank"), F.col("group_n"), k)).drop(
        "rank", "group_n"
    )


def ceil_blocks(windows: DataFrame, k: int, group: list[str] = ["label"]) -> DataFrame:
    """Folds of ceil(n / k) windows in order; the last ones may be short or empty."""
    ranked = ordered_rank(windows, group, WINDOW)
    block = F.ceil(F.col("group_n") / k)
    return ranked.withColumn("fold", F.floor(F.col("rank") / block).cast("int")).drop(
        "rank", "group_n"
    )


def kfold_recordings(
    recordings: DataFrame,
    k: int,
    rounds: int = 1,
    shuffle: bool = True,
    group: list[str] = ["label"],
) -> DataFrame:
    """Folds over whole recordings: floor(n / k) of them each, the rest train only (fold NULL)."""
    if shuffle:
        ranked = digest_rank(
            with_rounds(recordings, rounds), ["round", *group], _shuffle_text(RECORDING), RECORDING
        )
        size = F.floor(F.col("group_n") / k)
        fold = F.floor(F.col("rank") / F.nullif(size, F.lit(0)))
    else:
        ranked = ordered_rank(recordings, group, RECORDING)
        size = F.floor(F.col("group_n") / k)
        fold = F.floor(F.col("rank") / F.nullif(size, F.lit(0)))
    return ranked.withColumn("fold", F.when(fold < k, fold).cast("int")).drop("rank", "group_n")


def leave_one_well_out(windows: DataFrame, wells: list[int] = TEST_WELLS) -> DataFrame:
    """Fold f validates the windows of the f-th well; other wells only train."""
    number = F.array_position(F.lit(wells), F.col("well_id"))
    return windows.withColumn("fold", F.nullif(number - 1, F.lit(-1)).cast("int"))


def inner_folds(
    folded: DataFrame, k: int = 4, inner: int = 4, keys=WINDOW
) -> DataFrame:
    """Shuffled folds inside the training side of each outer fold, labels mixed."""
    train = expand_folds(folded, k).where(F.col("split") == "train").drop("split")
    text = F.concat_ws("|", "round", "fold", *keys)
    ranked = digest_rank(train, ["round", "fold"], text, list(keys))
    return ranked.withColumn("inner", tile(F.col("rank"), F.col("group_n"), inner)).drop(
        "rank", "group_n"
    )


def expand_folds(folded: DataFrame, k: int, column: str = "fold") -> DataFrame:
    """Train and validation rows of every fold: `k` copies of each row, with `split`."""
    own = F.col("own")
    return (
        folded.withColumnRenamed(column, "own")
        .withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("split", F.when(own == F.col(column), "valid").otherwise("train"))
        .drop("own")
    )


def skip_wells(windows: DataFrame, wells: list[int]) -> DataFrame:
    """Route the named wells out of every fold, into the test side."""
    return windows.withColumn(
        "split", F.when(F.col("well_id").isin(wells), "test").otherwise("train")
    )


def on_recordings(windows: DataFrame, chosen: DataFrame, inside: bool = True) -> DataFrame:
    """Windows of the chosen recordings, or of all others."""
    return windows.join(chosen.select(*RECORDING), RECORDING, "left_semi" if inside else "left_anti")


def sample_order(windows: DataFrame, seed: int, keys=WINDOW) -> DataFrame:
    """Number the rows in a seeded shuffled order, from 1."""
    text = F.concat_ws("|", F.lit(seed), *keys)
    ranked = digest_rank(windows, [], text, list(keys))
    return ranked.withColumn("sample_order", F.col("rank") + 1).drop("rank", "group_n")


def fold_health(folded: DataFrame, k: int, by: list[str] = []) -> DataFrame:
    """Train and validation sizes per fold, flagging an empty side and excess positives.

    Folds are counted on the assignment, without copying rows; a fold nobody validates still has
    its row.
    """
    own = folded.groupBy(*by, F.col("fold").alias("own"), "label").agg(
        F.count(F.lit(1)).alias("n")
    )
    every = own.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    valid = F.col("own").eqNullSafe(F.col("fold"))

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    counts = every.groupBy(*by, "fold").agg(
        total(~valid & (F.col("label") == 0)).alias("train_neg"),
        total(~valid & (F.col("label") == 1)).alias("train_pos"),
        total(valid & (F.col("label") == 0)).alias("test_neg"),
        total(valid & (F.col("label") == 1)).alias("test_pos"),
    )
    return counts.withColumns(
        {
            "empty_test": (F.col("test_neg") == 0) | (F.col("test_pos") == 0),
            "more_positives": F.col("test_pos") > F.col("test_neg"),
        }
    )
