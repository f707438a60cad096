"""Pearson correlation of every feature pair, per fold and side, with significance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from faultline.operators.moments import fold_products, side_products
from faultline.operators.scaling import NOISE


def pearson_matrix(
    folded: DataFrame, features: list[str], k: int, by: list[str] = ["round"]
) -> DataFrame:
    """(by, fold, split, a, b, n, r) for features a before b; r is 0 where either is constant.

    Scaling does not change r, so one pass over the raw features serves every fold and side.
    """
    key = [*by, "fold", "split"]
    sides = side_products(fold_products(folded, features, by), k, by, per_label=False)
    count = sides.where((F.col("i") == -1) & (F.col("j") == -1)).select(*key, F.col("s").alias("n"))
    sums = sides.where((F.col("i") == -1) & (F.col("j") >= 0)).select(
        *key, F.col("j").alias("f"), F.col("s").alias("total")
    )
    squares = sides.where((F.col("i") == F.col("j")) & (F.col("i") >= 0)).select(
        *key, F.col("i").alias("f"), F.col("s").alias("square"), F.col("shift_i").alias("shift")
    )
    spread = F.col("square") - F.col("total") * F.col("total") / F.col("n")
    size = F.abs(F.col("shift") + F.col("total") / F.col("n"))
    single = (
        sums.join(squares, [*key, "f"])
        .join(count, key)
        .withColumn("spread", F.greatest(spread, F.lit(0.0)))
        .withColumn("flat", F.sqrt(F.col("spread") / F.col("n")) <= NOISE * size)
        .select(*key, "f", "total", "spread", "flat", "n")
    )

    def side(letter: str) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{letter}") for c in ("total", "spread", "flat")]
        extra = ["n"] if letter == "i" else []
        return single.select(*key, F.col("f").alias(letter), *named, *extra)

    both = F.col("s") - F.col("total_i") * F.col("total_j") / F.col("n")
    r = both / F.sqrt(F.col("spread_i") * F.col("spread_j"))
    flat = F.col("flat_i") | F.col("flat_j") | (F.col("spread_i") * F.col("spread_j") == 0)
    names = F.lit(features)
    return (
        sides.where((F.col("i") >= 0) & (F.col("i") < F.col("j")))
        .join(side("i"), [*key, "i"])
        .join(side("j"), [*key, "j"])
        .select(
            *key,
            F.get(names, F.col("i")).alias("a"),
            F.get(names, F.col("j")).alias("b"),
            F.col("n").cast("bigint").alias("n"),
            F.when(flat, 0.0).otherwise(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).alias("r"),
        )
    )


def pearson_f(pairs: DataFrame) -> DataFrame:
    """Add the F statistic of r on 1 and n - 2 degrees of freedom."""
    r2 = F.col("r") * F.col("r")
    return pairs.withColumn("f_stat", r2 * (F.col("n") - 2) / F.nullif(1 - r2, F.lit(0.0)))


#: Nodes of the p-value's quadrature.
NODES = 64


def pearson_p(pairs: DataFrame) -> DataFrame:
    """Add the two-sided p-value of r, from the beta distribution of r squared.

    With r^2 = sin(t)^2 the density's integrand is cos(t)^(n - 3), smooth and falling from t0 to pi/2; the
    Gauss-Legendre nodes are spread over the stretch that holds its mass, so any number of rows needs as many.
    """
    points, weights = (F.lit(x.tolist()) for x in np.polynomial.legendre.leggauss(NODES))
    n, size = F.col("n").cast("double"), F.abs("r")
    a, power = n / 2 - 1, n - 3
    end, start = F.lit(math.pi / 2), F.asin(F.least(size, F.lit(1.0)))
    # Beyond `reach` the integrand is below 1e-20 of its start.
    floor = F.log(F.cos(start)) - F.lit(46.0) / F.greatest(power, F.lit(1e-9))
    reach = F.least(end, F.acos(F.exp(F.least(floor, F.lit(0.0)))))
    half = (reach - start) / 2

    def term(x: Column, weight: Column) -> Column:
        return weight * F.exp(power * F.log(F.cos(start + half * (x + 1))) + _log_norm(a))

    area = F.aggregate(F.zip_with(points, weights, term), F.lit(0.0), lambda total, x: total + x) * half
    return pairs.withColumn("p_value", F.when(n <= 2, 1.0).when(size >= 1, 0.0).otherwise(F.least(area, F.lit(1.0))))


def _log_norm(a: Column) -> Column:
    """log of 2 Gamma(a + 1/2) / (Gamma(a) Gamma(1/2)): the ratio 16 steps further up by its series, and the steps."""
    z = a + 16
    series = F.log(z) / 2 - 1 / (8 * z) + 1 / (192 * z * z * z) - 1 / (640 * z * z * z * z * z)
    steps = F.aggregate(
        F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda total, i: total + F.log((a + i) / (a + i + F.lit(0.5)))
    )
    return series + steps + F.lit(math.log(2.0) - math.log(math.pi) / 2)
