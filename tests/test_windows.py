"""Positions, windows, fill and entropy on hand-sized recordings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import clean, entropy, fill, ordering, windows
from faultline.sources.tables import lineitem_readings


def recording(spark, values, class_id=0, instance=1):
    rows = [(class_id, instance, i, i, None if v is None else float(v)) for i, v in enumerate(values)]
    schema = "class_id int, instance_id int, t int, seq int, v1 double"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t")).drop("t")


def features(df, size, step, **kwargs):
    made = windows.window_features(df, size, step, ["v1"], keep=(), **kwargs)
    return made.orderBy("class_id", "instance_id", "w").collect()


@pytest.mark.parametrize(
    "rows, size, step, drop_last, expected",
    [
        (8, 4, 4, True, 1),
        (8, 4, 4, False, 2),
        (3, 4, 4, True, 1),
        (12, 4, 2, True, 4),
        (12, 4, 2, False, 5),
        (12, 4, 6, True, 1),
        (20, 4, 6, False, 3),
    ],
)
def test_window_count(spark, rows, size, step, drop_last, expected):
    made = features(recording(spark, range(rows)), size, step, drop_last=drop_last)
    assert [r.w for r in made] == list(range(expected))
    for r in made:
        part = np.arange(rows, dtype=float)[r.w * step : r.w * step + size]
        assert r.v1_max == part.max() and r.v1_min == part.min()
        assert r.v1_mean == pytest.approx(part.mean())
        assert r.v1_median == pytest.approx(np.median(part))
        assert r.v1_std == pytest.approx(part.std(ddof=1))
        assert r.v1_var == pytest.approx(part.var(ddof=1))


def test_short_recording_is_one_partial_window(spark):
    (only,) = features(recording(spark, [5.0, 7.0]), 10, 10)
    assert (only.v1_max, only.v1_min, only.v1_mean) == (7.0, 5.0, 6.0)


def test_single_row_window_has_no_deviation_and_is_masked(spark):
    made = windows.window_features(recording(spark, [5.0]), 10, 10, ["v1"], keep=())
    assert made.first().v1_std is None
    assert clean.mask_nonfinite(made, windows.feature_names(["v1"])).count() == 0


def test_missing_value_leaves_window_without_statistics(spark):
    df = recording(spark, [1, 2, None, 4, 5, 6, 7, 8])
    first, second = features(df, 4, 4, drop_last=False, missing=True)
    assert first.v1_mean is None and second.v1_mean == 6.5


def test_own_statistics(spark):
    more = windows.STATISTICS | {"range": lambda v: F.max(v) - F.min(v)}
    (only,) = features(recording(spark, [1, 4, 9]), 5, 5, statistics=more)
    assert only.v1_range == 8.0


def test_concat_windows_straddle_recordings(spark):
    both = recording(spark, range(3), 0, 1).unionByName(recording(spark, range(10, 15), 2, 1))
    made = windows.window_features_concat(
        both.withColumn("label", F.lit(0)), 4, 4, ["label"], variables=["v1"], drop_last=False
    )
    assert [r.v1_max for r in made.orderBy("w").collect()] == [10.0, 14.0]


def skewed(spark, folder):
    """One supplier holds most rows."""
    rows = lineitem_readings(spark, folder)
    hot = F.when(F.col("seq.l_orderkey") % 3 > 0, 0).otherwise(F.col("instance_id"))
    return rows.withColumn("instance_id", hot)


def test_ranges_change_nothing(spark, folder):
    rows = clean.drop_incomplete(skewed(spark, folder))
    whole, cut = ordering.positions(rows, parts=1), ordering.positions(rows, parts=40)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == rows.count()
    sizes = ordering.ordered(rows, parts=40).groupBy("piece").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < rows.count() / 8 and sizes[1] > 20


def test_ranges_change_no_concatenation(spark, folder):
    rows = clean.labelled(clean.drop_incomplete(skewed(spark, folder)), [4], [0])

    def made(parts):
        df = windows.window_features_concat(rows, 20, 20, ["label"], parts=parts)
        return df.orderBy("label", "w").toPandas()

    whole, cut = made(1), made(40)
    exact = ["label", "w", *(f"v{i}_{s}" for i in range(1, 6) for s in ("max", "min", "median"))]
    assert whole[exact].equals(cut[exact])
    assert np.allclose(whole, cut, rtol=1e-12, atol=1e-12)


def test_fill_carries_between_ranges(spark, folder):
    rows = skewed(spark, folder)
    whole, cut = fill.forward_fill(rows, parts=1), fill.forward_fill(rows, parts=40)
    assert whole.exceptAll(cut).count() == 0 and cut.count() == rows.count()
    filled = fill.forward_fill(recording(spark, [None, 1, None, None, 2, None]), ["v1"])
    assert [r.v1 for r in filled.orderBy("ts").collect()] == [None, 1, 1, 1, 2, 2]


def test_one_recording_with_nearly_all_rows_in_one_second(spark):
    hot = recording(spark, range(20_000)).withColumn("ts", F.timestamp_seconds(F.lit(7)))
    df = hot.unionByName(recording(spark, range(200), 1, 5))
    placed = ordering.positions(df, parts=16)
    assert placed.where(F.col("pos") != F.col("seq")).count() == 0
    assert placed.groupBy("n_rows").count().count() == 2
    spread = ordering.ordered(df, parts=16).groupBy("piece").count().agg(F.max("count")).first()[0]
    assert spread < 5000
    (a, b) = (windows.window_features(x, 50, 50, ["v1"], keep=()).count() for x in (df, placed))
    assert a == b


def test_exclusive_sum_with_many_cells(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), F.col("id"), (F.col("id") * 7 % 11).alias("n")
    )
    got = ordering.exclusive_sum(df, ["g"], ["id"], "n", "before", "total", cells=16)
    rows = {(r.g, r.id): (r.before, r.total) for r in got.collect()}
    for g in range(3):
        run, total = 0, sum(i * 7 % 11 for i in range(g, 5000, 3))
        for i in range(g, 5000, 3):
            assert rows[(g, i)] == (run, total)
            run += i * 7 % 11


def brute_entropy(x, m, r):
    def count(rows, length, others):
        return sum(
            max(abs(x[i + t] - x[j + t]) for t in range(length)) <= r
            for i in range(rows)
            for j in range(others)
        ) - rows

    n = len(x)
    return count(n - m, m, n - m + 1), count(n - m, m + 1, n - m)


def test_sample_entropy(spark):
    x = [1, 2, 1, 2, 1, 3, 1, 2, 1, 2, 4, 1]
    df = recording(spark, x)
    row = entropy.sample_entropy(df, 12, 12, 2, {"v1": 0.5}, ["v1"]).first()
    b, a = brute_entropy(x, 2, 0.5)
    assert (row.v1_b, row.v1_a) == (b, a)
    assert row.v1_entropy == pytest.approx(-math.log(a / b))
    short = entropy.sample_entropy(recording(spark, [1, 2]), 12, 12, 2, {"v1": 0.5}, ["v1"]).first()
    assert (short.v1_b, short.v1_a, short.v1_entropy) == (0, 0, None)
