"""Held-out accuracy, a plain version of the score, and odd rows."""

import zlib

import numpy as np
import pytest

from faultline.llm import toxicity as op
from faultline.llm.grams import RADIX

LABELS = "doc_id bigint, toxic int"


def plain_score(model, text):
    weight = dict(zip(model.chosen.tolist(), model.weights))
    low, found = (text or "").lower(), set()
    for n in op.SIZES:
        for i in range(len(low) - n + 1):
            h = 0
            for ch in low[i : i + n]:
                h = (h * RADIX + ord(ch) + 1) % 2**64
            found.add(h)
    return 1 / (1 + np.exp(-(model.bias + sum(weight.get(h, 0.0) for h in found))))


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return op.train(docs, labels), docs, labels


def test_held_out_accuracy(model):
    fitted, docs, labels = model
    rows = op.score(docs.withColumn("held", op.held_out()), fitted).join(labels, "doc_id").where("held").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum((r.toxicity >= 0.5) == (r.toxic == 1) for r in rows) >= 0.95 * len(rows)


def test_scores_equal_the_plain_version(model, make_docs):
    fitted, docs, _ = model
    texts = [r.text for r in docs.limit(15).collect()] + ["", None, "ab", "IDIOT loser", "é" * 50, "idiot " * 40_000]
    for r in op.score(make_docs(texts), fitted).collect():
        assert abs(r.toxicity - plain_score(fitted, texts[r.doc_id])) < 1e-9


def test_held_out_labels_are_not_seen(spark, make_docs):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    texts = ["vile words here" if i % 2 else "kind words there" for i in range(400)]
    labels = [(i, 1 - i % 2) for i in held]  # wrong, and only on held-out rows
    seen = [(i, i % 2) for i in range(400) if i not in set(held)]
    fitted = op.train(make_docs(texts), spark.createDataFrame(labels + seen, LABELS))
    assert all((r.toxicity >= 0.5) == bool(r.doc_id % 2) for r in op.score(make_docs(texts), fitted).collect())
    none = op.train(make_docs(texts), spark.createDataFrame(labels, LABELS))
    assert len(none.chosen) == 0 and op.score(make_docs(texts), none).where("toxicity >= 0.5").count() == 0


def test_odd_labels_names_and_empty_tables(spark, make_docs):
    texts = ["vile words here" if i % 2 else "kind words there" for i in range(100)]
    rows = [(i, i % 2) for i in range(100)] + [(1, 0), (2, None), (None, 1), (3, 7), (10_000, 1)]
    df = make_docs(texts).withColumnRenamed("source", "label").withColumnRenamed("lang", "toxicity")
    fitted = op.train(df, spark.createDataFrame(rows, LABELS))
    out = op.score(df, fitted, name="score")
    assert out.columns == [*df.columns, "score"] and out.where("(score >= 0.5) = (doc_id % 2 = 1)").count() == 100
    assert op.score(make_docs([]), fitted).collect() == []
    for labels in ([], [(1, 1)], [(2, 0)]):
        op.train(make_docs(texts), spark.createDataFrame(labels, LABELS))
    assert len(op.train(make_docs([]), spark.createDataFrame(rows, LABELS)).chosen) == 0
