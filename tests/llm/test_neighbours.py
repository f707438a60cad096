"""Block join search against all inner products."""

import math

import numpy as np
import pytest

from faultline.llm import neighbours as op


def brute(rows, k, modulo):
    ok = [
        (i, v) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    out = []
    for q, v in ok:
        if q % modulo == 0:
            best = []
            for i, w in ok:
                if i != q and len(w) == len(v):
                    s = 0.0
                    for a, b in zip(v, w):
                        s += a * b
                    best.append((-s, i))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(best)[:k], 1)]
    return sorted(out)


def run(spark, rows, k, modulo, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")
    return sorted(map(tuple, op.search(df, df.where(f"vec_id % {modulo} = 0"), k).collect()))


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [(i, [float(i % 4), 1.0, -2.0 * (i % 3)]) for i in range(40)]
    rows += [(40, None), (41, [0.0, 0.0, 0.0]), (42, [1.0, None, 2.0]), (43, [1.0, math.nan, 1.0]), (60, [math.inf, 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (80, [1.0, 2.0]), (81, [3.0, 4.0]), (100, []), (120, [1e-200, 0.0, 0.0]), (7, [9.0, 9.0, 9.0])]
    assert run(spark, rows, 5, 20) == brute(rows, 5, 20)


@pytest.mark.parametrize("dim", [3, 64, 1200])
def test_random_blocks(spark, monkeypatch, dim):
    monkeypatch.setattr(op, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(op, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(400, dim)) * 10.0 ** rng.integers(-3, 3, (400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert run(spark, rows, 20, 20) == brute(rows, 20, 20)


def test_empty_table(spark):
    assert run(spark, [], 20, 20) == []
