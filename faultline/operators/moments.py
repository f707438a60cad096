"""Per-fold moments of features, and the training-side statistics built from them.

Every row is counted once, in the fold that validates it. The training side of fold f is the
merge of all other folds' moments: a few rows per feature, so no training row is ever copied and
nothing is subtracted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T


def fold_moments(folded: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(by, own, label, feature): row count, mean and sum of squared deviations."""
    # Short rows of one value each are aggregated in their tasks before anything is exchanged; one wide aggregate
    # of all features was measured to take three times as long.
    long_ = folded.withColumnRenamed("fold", "own").unpivot([*by, "own", "label"], features, "feature", "x")
    return long_.groupBy(*by, "own", "label", "feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("m2")
    )


def train_moments(
    moments: DataFrame, k: int, by: list[str], per_label: bool = False
) -> DataFrame:
    """(by, fold, [label,] feature): n, mean and population variance of each training side."""
    sides = moments.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(
        ~F.col("own").eqNullSafe(F.col("fold"))
    )
    key = [*by, "fold", *(["label"] if per_label else []), "feature"]
    whole = Window.partitionBy(*key)
    centred = sides.withColumn(
        "centre", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    )
    spread = F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("centre"), F.lit(2.0))
    return centred.groupBy(*key).agg(
        F.sum("n").alias("n"),
        F.first("centre").alias("mean"),
        (F.sum(spread) / F.sum("n")).alias("var_pop"),
    )


def fold_products(folded: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(by, own, label, i, j): row count and summed products of features i <= j, centred.

    Products are summed inside each task, which hands on one matrix per group. Features are
    centred on their overall means first, so sums keep their digits. Also carries `shift_i`,
    `shift_j`; index -1 stands for the constant 1, so (-1, j) holds plain sums and (-1, -1) counts.
    """
    centre = folded.agg(*(F.avg(c).alias(c) for c in features)).first()
    shift = np.array([centre[c] if centre[c] is not None else 0.0 for c in features])
    keys = [*by, "own", "label"]
    narrow = folded.withColumnRenamed("fold", "own").select(*keys, *features)
    size = len(features) + 1
    upper_i, upper_j = np.triu_indices(size)

    def multiply(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                x = np.empty((len(rows), size))
                x[:, 0] = 1.0
                x[:, 1:] = rows[features].to_numpy(dtype=float) - shift
                # A missing fold number makes the column's whole numbers floats.
                whole = tuple(
                    None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in key
                )
                product = (x.T @ x)[upper_i, upper_j]
                sums[whole] = sums[whole] + product if whole in sums else product
        for key, product in sums.items():
            out = pd.DataFrame({"i": upper_i - 1, "j": upper_j - 1, "s": product})
            yield out.assign(**dict(zip(keys, key)))[[*keys, "i", "j", "s"]]

    schema = T.StructType(
        [narrow.schema[c] for c in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())]
        + [T.StructField("s", T.DoubleType())]
    )
    for field in schema:
        field.nullable = True
    return (
        narrow.mapInPandas(multiply, schema)
        .groupBy(*keys, "i", "j")
        .agg(F.sum("s").alias("s"))
        .withColumn("shift_i", F.get(F.lit([0.0, *map(float, shift)]), F.col("i") + 1))
        .withColumn("shift_j", F.get(F.lit([0.0, *map(float, shift)]), F.col("j") + 1))
    )


def side_products(products: DataFrame, k: int, by: list[str], per_label: bool) -> DataFrame:
    """Products of each fold's training and validation sides: (by, fold, split, [label,] i, j)."""
    own = F.col("own").eqNullSafe(F.col("fold"))
    return (
        products.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("split", F.when(own, "valid").otherwise("train"))
        .groupBy(*by, "fold", "split", *(["label"] if per_label else []), "i", "j")
        .agg(F.sum("s").alias("s"), F.first("shift_i").alias("shift_i"), F.first("shift_j").alias("shift_j"))
    )
