"""Statistics carried from window to window, and many recordings summarised at once."""

import numpy as np
import pyarrow as pa
import pytest

from faultline.operators import pieces

NAMES = ["max", "mean", "median", "min", "std", "var"]


@pytest.mark.parametrize("size", [16, 17, 64])
def test_rolling_is_what_each_window_gives(size):
    rng = np.random.default_rng(size)
    column = rng.normal(size=501)
    column[100] = 1e12  # windows after it must not feel it
    column[200:300] = 7.0
    got = pieces._rolling(column, size, NAMES)
    want = pieces._statistics(np.lib.stride_tricks.sliding_window_view(column, size), NAMES, False)
    for name in NAMES:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-9, atol=1e-9, err_msg=name)


def test_absent_and_infinite_values_take_the_plain_way():
    column = np.arange(200.0)
    column[[20, 90]] = np.nan, np.inf
    begin = np.arange(200 - 32 + 1)
    got = pieces._windowed(column, begin, 32, 1, NAMES, False)
    want = pieces._statistics(np.lib.stride_tricks.sliding_window_view(column, 32), NAMES, False)
    for name in NAMES:
        np.testing.assert_array_equal(got[name], want[name])


def test_recordings_are_summarised_together():
    """Three recordings in one call: one of two windows, one shorter than a window, one that goes on elsewhere."""
    rows = pa.table({"class_id": [0] * 6 + [1] * 3 + [2] * 7, "instance_id": [5] * 6 + [6] * 3 + [7] * 7, "v1": np.arange(16.0)})
    start, first, ended = np.array([0, 6, 9]), np.array([0, 0, 2]), np.array([True, True, False])
    columns = (["class_id", "instance_id"], ["v1"], ["max", "mean"])
    windows, edge = pieces._summaries(rows, start, first, ended, (4, 2, False, False), columns)
    got = sorted(zip(*(windows.column(c).to_pylist() for c in ("class_id", "w", "v1_max", "v1_mean"))))
    assert got == [(0, 0, 3.0, 1.5), (0, 1, 5.0, 3.5), (1, 0, 8.0, 7.0), (2, 1, 12.0, 10.5), (2, 2, 14.0, 12.5)]
    assert set(edge.column("class_id").to_pylist()) == {2}
    assert edge.column("pos").to_pylist() == [2, 3, 4, 5, 6, 7, 8]


@pytest.mark.parametrize("drop_last", [True, False])
@pytest.mark.parametrize("parts", [3, 7, 40])
def test_dense_windows_across_ranges(spark, monkeypatch, parts, drop_last):
    """Windows at every row or two, over ranges longer and shorter than a window, against a plain loop."""
    from faultline.operators import windows

    crossed = []
    plain = pieces._across_ends
    monkeypatch.setattr(pieces, "_across_ends", lambda *a: crossed.append(1) or plain(*a))
    rng = np.random.default_rng(parts)
    values = {0: rng.normal(size=700), 1: rng.normal(size=20), 2: rng.normal(size=33), 3: rng.normal(size=32)}
    rows = [(0, k, i, 0, float(x)) for k, v in values.items() for i, x in enumerate(v)]
    readings = spark.createDataFrame(rows, "class_id int, instance_id long, ts long, seq int, v1 double").repartition(4)
    for step in (1, 2):
        made = windows.window_features(readings, 32, step, ["v1"], keep=(), drop_last=drop_last, parts=parts).toPandas()
        want = {}
        for k, v in values.items():
            n = max((len(v) - 32) // step + (0 if drop_last else 1), 1)
            want |= {(k, w): v[w * step : w * step + 32] for w in range(n)}
        got = {(r.instance_id, r.w): r for r in made.itertuples()}
        assert got.keys() == want.keys() and len(made) == len(want)
        for at, x in want.items():
            shown = [getattr(got[at], f"v1_{s}") for s in NAMES]
            np.testing.assert_allclose(shown, [x.max(), x.mean(), np.median(x), x.min(), x.std(ddof=1), x.var(ddof=1)], rtol=1e-9)
    assert crossed or parts == 40
