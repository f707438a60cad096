"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
from plain import groups, simhash

from faultline.llm import simhash as op
from faultline.llm.common import Stages


def check(df, docs):
    got = {r.doc_id: r for r in op.near_groups(df).collect()}
    prints = {i: simhash(t) for i, t in docs.items()}
    want = groups(prints)
    assert {i: r.fingerprint % 2**64 for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == want
    return want


def test_whole_table(documents, rows_of):
    assert len(set(check(documents, rows_of).values())) < len(rows_of)


def test_edge_texts(make_docs):
    texts = ["", None, " \t", "One", "one", "two words", "a b c d", "a b c d a b c d", "é É ß", "x " * 5000, "ab " * 3]
    check(make_docs(texts), dict(enumerate(texts)))


def test_near_copies_chain(make_docs):
    pick = random.Random(7)
    words = [f"w{pick.randrange(10**6)}" for _ in range(400)]
    texts = []
    for i in range(60):
        words[pick.randrange(400)] = f"n{i}"
        texts.append(" ".join(words))
    want = check(make_docs(texts), dict(enumerate(texts)))
    assert len(set(want.values())) < 60


def test_null_and_repeated_ids_keep_one_row_each(make_docs):
    same, other = "one text of some words here", "quite another text that has other words"
    df = make_docs([(7, same), (7, same), (None, same), (3, same), (None, other), (9, other), (None, "alone in the table it is"), (4, "")])
    got = [(r.doc_id, r.component_id) for r in op.near_groups(df).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(3, 3), (4, 4), (7, 3), (7, 3), (9, 9)]
    assert {x for i, x in got if i is None} == {3, 9, None}
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    rows = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert rows == [(False, 3), (False, 4), (False, 9), (True, 0)]


def test_empty_table(make_docs):
    assert op.near_groups(make_docs([])).collect() == []
    assert op.keep_one(make_docs([])).collect() == []


@pytest.mark.parametrize("same", [True, False])
def test_tiles_find_all_links(same):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    near = a[:300] ^ flips ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    if same:
        left, right = np.unique(np.concatenate([a, near])), None
        nodes = left
    else:
        left, right = np.unique(a), np.unique(near)
        nodes = np.concatenate([left, right])
    u, v = op.star_edges(left, right, 4)
    star = dict(zip(u.tolist(), v.tolist()))
    prints = {int(x): int(x) for x in nodes}
    want = groups(prints)
    parts = {}
    for x in prints:
        parts.setdefault(star.get(x, x), set()).add(want[x])
    assert all(len(p) == 1 for p in parts.values()) and len(parts) == len(set(want.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 9), (2, 2)], "u bigint, v bigint")
    got = {r.u: r.root for r in op.components(edges, Stages(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + k: 1000 for k in range(1, 300)}}
