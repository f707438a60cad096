"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training reads a bounded sample of labelled documents per class. Which n-grams (3 to 6 characters, present
or not) tell the classes apart is counted over the sample in hash buckets; the best ones, each scaled by the
logarithm of its smoothed ratio of class frequencies, feed a logistic regression. Scoring is one pass over
all documents with the small model in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import Stages, grouped, mix, task, text_slices
from faultline.llm.grams import Lookup, characters, hashes

SIZES = range(3, 7)
SLICE_BYTES = 1 << 19
#: Labelled rows of each class that training reads at most, in expectation: the sample's bound.
CLASS_ROWS = 2000
#: n-grams the model keeps, and in how many sampled documents one must occur.
FEATURES, LEAST_DOCS, LEAST_RATIO = 2048, 5, 1.0
BUCKETS, SAMPLE_TASKS = 64, 8
SMOOTHING, RIDGE, ROUNDS = 1.0, 0.1, 600


@dataclass
class Model:
    """score = sigmoid(bias + sum of the weights of the chosen n-grams that occur)."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels training must not see."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of about CLASS_ROWS labelled training rows of each class, chosen by a hash of the id; and
    how many labelled rows each class has. Of repeated labels of one id the largest counts."""
    c = F.col
    known = labels.where(c(label).isin(0, 1) & c(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(c(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    size = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        return None, size
    share = F.lit(0.0)
    for value, n in size.items():
        share = F.when(c("label") == value, min(1.0, CLASS_ROWS / n)).otherwise(share)
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(c(doc_id).alias("id"), c(text).cast("string").alias("text"))
    # At most about 2 x CLASS_ROWS ids, whatever the input's size.
    return rows.join(F.broadcast(chosen), "id").select("label", "text"), size


def _present(text: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, n-gram hash) once for each n-gram that occurs in a row."""
    codes, borders = characters(text)
    row = np.repeat(np.arange(len(text)), np.diff(borders))
    at, h = zip(*hashes(codes, borders, SIZES)) if len(codes) >= SIZES.start else ([np.zeros(0, np.int64)], [np.zeros(0, np.uint64)])
    rows, h = row[np.concatenate(at)], np.concatenate(h)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], h[new], len(text)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each n-gram, summed over the task, by hash bucket."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, 2), np.int32)
    for whole in batches:
        for batch in text_slices(whole, "text", SLICE_BYTES):
            rows, h, _ = _present(batch.column(1))
            label = batch.column(0).to_numpy()[rows]
            both = np.concatenate([keys, h])
            add = np.zeros((len(h), 2), np.int32)
            add[np.arange(len(h)), label] = 1
            keys, code = np.unique(both, return_inverse=True)
            total = np.zeros((len(keys), 2), np.int32)
            for k in (0, 1):
                total[:, k] = np.bincount(code, np.concatenate([counts[:, k], add[:, k]]), len(keys))
            counts = total
    bucket = (mix(keys.copy()) >> np.uint64(58)).astype(np.int64)
    for b in range(BUCKETS):
        at = np.flatnonzero(bucket == b)
        if len(at):
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array([b], pa.int32()), "keys": [keys[at].tobytes()], "counts": [counts[at].astype(np.int32).tobytes()]}
            )


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit the model. Without labelled training rows of both classes it has no features, and its bias gives
    the share of toxic rows among those there are (0 if there are none)."""
    spark = docs.sparkSession
    rows, size = sample(docs, labels, doc_id, text, label)
    none = np.zeros(0, np.uint64)
    if rows is None:
        return Model(none, np.zeros(0), 40.0 if size.get(1) else -40.0)
    stages = Stages(spark, "toxicity")
    rows = stages.keep(rows, "sample")
    by_class = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = by_class.get(0, 0), by_class.get(1, 0)
    if not n0 or not n1:
        return Model(none, np.zeros(0), -40.0)

    def choose(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys").combine_chunks()])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in table.column("counts").combine_chunks()])
        keys, code = np.unique(keys, return_inverse=True)
        a, b = (np.bincount(code, counts[:, k], len(keys)) for k in (0, 1))
        ratio = np.log((b + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((a + SMOOTHING) / (n0 + 2 * SMOOTHING))
        # Worth: the log-likelihood ratio of the counts. Weak ratios are left out, since long texts have all
        # common n-grams and their small weights would add up.
        worth = _likelihood_ratio(a, b, n0, n1)
        worth[(a + b < LEAST_DOCS) | (np.abs(ratio) < LEAST_RATIO)] = 0
        best = np.argsort(-worth, kind="stable")[:FEATURES]
        best = best[worth[best] > 0]
        return pa.table([pa.array(keys[best].view(np.int64)), pa.array(ratio[best]), pa.array(worth[best])], names=["key", "ratio", "worth"])

    dealt = rows.repartition(SAMPLE_TASKS, F.xxhash64("text"))
    counted = dealt.mapInArrow(task(_counts), "bucket int, keys binary, counts binary")
    best = counted.groupBy("bucket").applyInArrow(grouped(choose), "key bigint, ratio double, worth double")
    best = best.orderBy(F.desc("worth"), "key").limit(FEATURES).toPandas()
    chosen, ratio = best["key"].to_numpy().view(np.uint64), best["ratio"].to_numpy()
    find = Lookup(chosen)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE_BYTES):
                codes, borders = characters(batch.column(1))
                has = _occurring(codes, borders, find)
                cuts = np.searchsorted(has[0], np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([has[1][a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                    names=["label", "has"],
                )

    # One short row per sampled document: bounded by the sample and the feature count.
    table = rows.mapInArrow(task(features), "label int, has binary").toPandas()
    x = np.zeros((len(table), len(chosen)), np.float32)
    for i, has in enumerate(table["has"]):
        at = np.frombuffer(has, np.int32)
        x[i, at] = ratio[at]
    weights, bias = _logistic(x, table["label"].to_numpy(), size)
    stages.drop(rows)
    return Model(chosen, weights * ratio, bias)


def _likelihood_ratio(a: np.ndarray, b: np.ndarray, n0: int, n1: int) -> np.ndarray:
    """Twice the gain in log-likelihood when an n-gram's frequency may differ between the classes."""

    def part(k: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return k * np.log(np.where(k > 0, k, 1) / np.maximum(expected, 1e-300))

    both = (a + b) / (n0 + n1)
    return 2 * (part(a, n0 * both) + part(b, n1 * both) + part(n0 - a, n0 * (1 - both)) + part(n1 - b, n1 * (1 - both)))


def _logistic(x: np.ndarray, y: np.ndarray, size: dict[int, int]) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; rows weigh as their class does in all labels."""
    share = np.array([size[0], size[1]]) / np.bincount(y, minlength=2)
    weight = share[y] / share[y].mean()
    # The step fits the largest curvature, found by power iteration.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v)).astype(np.float32)
        v /= max(np.linalg.norm(v), 1e-12)
    top = float(np.sum(weight * (x @ v) ** 2)) / 4 + weight.sum() / 4 + RIDGE
    w, b = np.zeros(x.shape[1]), 0.0
    w_, b_, t = w, b, 1.0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w_.astype(np.float32) + b_, -40, 40)))
        d = (weight * (p - y)).astype(np.float32)
        w2, b2 = w_ - (x.T @ d + RIDGE * w_) / top, b_ - float(d.sum()) / top
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_, b_ = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def _occurring(codes: np.ndarray, borders: np.ndarray, find: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) once for each chosen n-gram that occurs in a row, by row."""
    n = max(1, len(find.mixed))
    row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    pairs = [np.zeros(0, np.int64)]
    for at, h in hashes(codes, borders, SIZES):
        i, feature = find.find(h)
        pairs.append(np.unique(row[at[i]] * n + feature))
    pairs = np.unique(np.concatenate(pairs))
    return pairs // n, pairs % n


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Every row of `docs`, all columns, with a column `name`: the score, 0 to 1. Null and empty texts get the model's score of
    no features; texts are read whole. A column of `docs` named like the new one is replaced."""
    kept = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    find, weights, bias = Lookup(model.chosen), model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text, SLICE_BYTES):
                codes, borders = characters(batch.column(batch.schema.get_field_index(text)))
                row, feature = _occurring(codes, borders, find)
                sums = np.bincount(row, weights[feature], batch.num_rows) + bias
                scores = 1 / (1 + np.exp(-np.clip(sums, -40, 40)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, name])

    return kept.mapInArrow(task(run), f"{schema}, `{name}` double")
