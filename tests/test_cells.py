"""Neighbours by cells of near points: the answer of all pairs, from few of them."""

import numpy as np
import pytest

from faultline.models import neighbours


def _rows(kind, n, rng):
    if kind == "spread":
        return rng.normal(size=(n, 30))
    if kind == "ties":
        return rng.integers(0, 3, (n, 30)).astype(float)
    if kind == "plane":
        return rng.integers(0, 100, (n, 2)).astype(float)
    return rng.normal(size=(n, 30)) * np.where(np.arange(n) % 97 == 0, 1e6, 1)[:, None] + 1e4


@pytest.mark.parametrize("kind", ["spread", "ties", "plane", "far"])
@pytest.mark.parametrize("k", [1, 4, 15])
def test_cells_give_what_all_pairs_give(kind, k):
    rng = np.random.default_rng(k)
    points, x = _rows(kind, 2500, rng), _rows(kind, 300, rng)
    label, copies = rng.integers(0, 2, len(points)), rng.integers(1, 4, len(points))
    got = neighbours._best_of_cells(x, points, label, copies, k)
    want = neighbours._best_of_all(x, points, label, copies, k)
    for a, b in zip(got, want, strict=True):
        for one, other in zip(a, b, strict=True):
            np.testing.assert_array_equal(one, other)


def test_few_pairs_are_looked_at(monkeypatch):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(8000, 3))
    looked = []
    plain = neighbours._distances
    monkeypatch.setattr(neighbours, "_distances", lambda x, p: looked.append(p.size // 3) or plain(x, p))
    neighbours._best(points[:500], points, np.zeros(8000, int), np.ones(8000, int), 1)
    assert 0 < sum(looked) < 500 * 8000 / 100


def test_null_features_still_answer():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(2000, 2))
    points[7, 1] = np.nan
    near = neighbours._best(points[:5], points, np.zeros(2000, int), np.ones(2000, int), 1)
    assert len(near) == 5


@pytest.mark.parametrize("kind", ["spread", "ties"])
@pytest.mark.parametrize("k", [1, 4, 15])
def test_block_after_block_gives_what_one_block_gives(kind, k):
    rng = np.random.default_rng(k)
    points, x = _rows(kind, 5000, rng), _rows(kind, 200, rng)
    label, copies = rng.integers(0, 2, len(points)).astype("int32"), rng.integers(1, 4, len(points))
    cuts = [0, 2000, 2010, 3500, 5000]
    blocks = ((points[a:b], label[a:b], copies[a:b]) for a, b in zip(cuts, cuts[1:]))
    got = neighbours._by_query(len(x), neighbours._nearest_of(x, blocks, k))
    want = neighbours._best_of_all(x, points, label, copies, k)
    for a, b in zip(got, want, strict=True):
        # Which of equal points comes last may differ, not what counts.
        (near, other), (mine, own) = ((d, label) for d, label, _ in (a, b))
        used, wanted = (neighbours._used(copies[None], k)[0] for *_, copies in (a, b))
        np.testing.assert_array_equal(np.repeat(near, used), np.repeat(mine, wanted))
        np.testing.assert_array_equal(np.repeat(other, used), np.repeat(own, wanted))


def test_later_blocks_start_from_the_bound_of_earlier_ones(monkeypatch):
    rng = np.random.default_rng(0)
    points = rng.normal(size=(6000, 10))
    bounds = []
    plain = neighbours._first_bound
    monkeypatch.setattr(neighbours, "_first_bound", lambda *a: bounds.append(1) or plain(*a))
    blocks = ((points[a : a + 2000], np.zeros(2000, "int32"), np.ones(2000, int)) for a in (0, 2000, 4000))
    neighbours._nearest_of(points[:100], blocks, 3)
    assert len(bounds) == 1


def test_low_products_are_found_by_words():
    rng = np.random.default_rng(2)
    held = np.empty(4096, np.float32), np.ones(4104, bool)
    for rows, columns in ((1, 1), (3, 5), (13, 17), (16, 16)):
        a, b = rng.normal(size=(rows, 4)).astype(np.float32), rng.normal(size=(4, columns)).astype(np.float32)
        np.testing.assert_array_equal(neighbours._at_most_zero(a, b, held), np.flatnonzero(a @ b <= 0))


def test_a_block_of_points_is_let_go_before_the_next_is_read(tmp_path):
    import weakref

    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"label": pa.array([0] * 10, pa.int32()), "copies": [1] * 10, "x": [float(v) for v in range(10)]}), tmp_path / "points")
    alive, most = [], 0
    def watched():
        nonlocal most
        for block in neighbours._point_blocks([f"file://{tmp_path}/points"], ["x"], 4):
            alive.append(weakref.ref(block[0]))
            most = max(most, sum(a() is not None for a in alive))
            points, label, copies = block
            del block
            yield points, label, copies
            del points
    row, distance, *_ = neighbours._nearest_of(np.array([[2.2], [9.0]]), watched(), 2)
    assert most == 1 and len(alive) == 3
    np.testing.assert_allclose(distance, [0.2, 0.8, 0.0, 1.0])
