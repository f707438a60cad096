"""The FM-index search against plain matching of all windows."""

import random

import numpy as np
import pytest
from plain import contamination
from pyspark.sql import functions as F

from faultline.llm import decontaminate as op


def check(spark, df, docs, items, **more):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = op.mark(df, bench, **more).withColumn("bad", op.is_contaminated()).collect()
    want = contamination(docs, items, more.get("window", 13))
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r.items, r.bad) == (n, hit, found, hit > 0 and 20 * hit >= n)
        assert sum(s.end - s.start for s in r.spans) == hit
    assert len(rows) == len(docs)
    return rows


def test_whole_table(spark, folder, documents, rows_of):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert any(r.bad for r in check(spark, documents, rows_of, items))


def test_short_items_nulls_and_overlaps(spark, make_docs):
    pick = random.Random(3)
    words = ["a", "b", "ab", "é", "9"]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    texts = [text(pick.randint(0, 50)) for _ in range(60)] + ["", None, "!!!", "A-B_ab", "B a,b. " * 3000]
    items = [(1, text(4)), (2, text(3)), (2, text(9)), (3, None), (4, ""), (5, "A"), (None, "b a b"), (6, text(30))]
    check(spark, make_docs(texts), dict(enumerate(texts)), items)
    check(spark, make_docs(texts), dict(enumerate(texts)), items[3:5])
    check(spark, make_docs(texts), dict(enumerate(texts)), items, window=3)


def test_many_blocks_give_the_same(spark, make_docs, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 64)
    pick = random.Random(4)
    text = lambda n: " ".join(f"w{pick.randrange(6)}" for _ in range(n))
    texts = [text(40) for _ in range(20)]
    check(spark, make_docs(texts), dict(enumerate(texts)), [(i, text(5)) for i in range(30)])


def test_names_in_use_empty_tables_and_repeated_rows(spark, make_docs):
    df = make_docs([(1, "x y z"), (1, "x y z")]).withColumn("spans", F.lit("mine")).withColumn("n_hit", F.lit(9))
    bench = spark.createDataFrame([(1, "y z")], "item_id bigint, text string")
    rows = op.mark(df, bench, prefix="b_").collect()
    assert [(r.spans, r.n_hit, r.b_n_hit) for r in rows] == [("mine", 9, 2)] * 2
    assert [r.n_hit for r in op.mark(df, bench).collect()] == [2, 2]
    assert [r.n_hit for r in op.mark(df, bench.limit(0)).collect()] == [0, 0]
    assert op.mark(make_docs([]), bench).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_index_counts_and_places(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(12)]
    text = np.concatenate([np.r_[0, r] for r in runs] + [[0]]).astype(np.int32)
    index = op.FMIndex(text, 3)
    rows = np.zeros((30, 4), np.int32)
    length = rng.integers(1, 5, 30)
    for i, n in enumerate(length):
        rows[i, :n] = rng.integers(1, 4, n)
    low, high = index.search(rows, length)
    for i, n in enumerate(length):
        want = [p for p in range(len(text) - n + 1) if (text[p : p + n] == rows[i, :n]).all()]
        assert sorted(index.locate(np.arange(low[i], max(low[i], high[i])))) == want
