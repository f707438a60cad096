"""Exact nearest neighbours by inner product: blocks of queries against blocks of all vectors.

Both sides are packed into blocks of rows. A task takes one pair of blocks, multiplies their int8 forms
in one matrix product, and has with it a bound on the error of each entry. What cannot reach the k-th
largest lower bound of its query is dropped; the rest is computed anew from the original components in
double precision. Each pair hands on k rows per query, and heaps merge these per query.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from faultline.llm.common import Stages, folder_for, grouped, per_process, read_file, task, write_file

VECTOR_BLOCK, QUERY_BLOCK = 8192, 512
#: Queries whose candidate lists are merged in one group.
MERGE_QUERIES = 8


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) of the vectors that take part."""
    ids, vectors = batch.column(0), batch.column(1)
    borders = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values
    flat = values.to_numpy(zero_copy_only=False)
    good_value = np.isfinite(flat) & np.asarray(values.is_valid())
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~good_value, out=bad[1:])
    live = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(good_value & (flat != 0), out=live[1:])
    a, b = borders[:-1], borders[1:]
    good = np.asarray(ids.is_valid()) & np.asarray(vectors.is_valid()) & (bad[b] == bad[a]) & (live[b] > live[a])
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique((b - a)[good]):
        at = np.flatnonzero(good & (b - a == size))
        yield int(size), number[at], flat[a[at][:, None] + np.arange(size)]


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows (block, size, n, path): files of up to `rows` ids and vectors of one dimension."""
    folder = folder_for(vectors.sparkSession, "vector-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(size: int) -> pa.RecordBatch:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(size)))
            name = uuid.uuid4().hex
            path = f"{folder}/{name}.bin"
            write_file(path, ids.astype(np.int64).tobytes() + data.tobytes())
            return pa.RecordBatch.from_pydict(
                {"block": [name], "size": pa.array([size], pa.int32()), "n": pa.array([len(ids)], pa.int64()), "path": [path]}
            )

        for batch in batches:
            for size, ids, data in _usable(batch):
                for at in range(0, len(ids), rows):
                    held.setdefault(size, []).append((ids[at : at + rows], data[at : at + rows]))
                    if sum(len(x[0]) for x in held[size]) >= rows:
                        yield block(size)
        for size in list(held):
            yield block(size)

    return vectors.mapInArrow(task(run), "block string, size int, n bigint, path string")


def unpack(path: str, size: int, n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the vectors of a block's file."""
    data = read_file(path)
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, kind, n * size, 8 * n).reshape(n, size)


class Quantized:
    """int8 forms of the rows, with what is needed to bound the error of their products."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.float64)
        self.scale = np.abs(x).max(axis=1) / 127
        tiny = self.scale < 1e-300
        self.codes = np.rint(x / np.where(tiny, 1, self.scale)[:, None]).clip(-127, 127).astype(np.int8)
        near = self.codes * self.scale[:, None]
        # A little more than the exact norms, for rounding.
        self.near_norm = np.sqrt((near**2).sum(axis=1)) * (1 + 1e-9)
        self.rest_norm = np.sqrt(((x - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-300
        self.norm = np.sqrt((x**2).sum(axis=1)) * (1 + 1e-9)


def nearest(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of the `k` best of this block for each query."""
    a, b = Quantized(q), Quantized(x)
    # Integers below 2**24 are exact in float32, which multiplies fastest.
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    about = (a.codes.astype(kind) @ b.codes.astype(kind).T).astype(np.float64)
    about *= a.scale[:, None]
    about *= b.scale[None, :]
    slack = np.outer(a.near_norm, b.rest_norm)
    slack += np.outer(a.rest_norm, b.norm)
    slack += 1e-12 * np.outer(a.norm, b.norm)
    own = q_ids[:, None] == x_ids[None, :]
    about[own] = -np.inf
    if len(x_ids) > k:
        floor = np.partition(about - slack, len(x_ids) - k, axis=1)[:, len(x_ids) - k]
        keep = about + slack >= floor[:, None]
    else:
        keep = np.ones(about.shape, bool)
    keep &= ~own
    i, j = np.nonzero(keep)
    score = np.zeros(len(i))
    for d in range(q.shape[1]):  # component by component: the same sum however the blocks are cut
        score += q[i, d].astype(np.float64) * x[j, d].astype(np.float64)
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return i[best], j[best], score[best]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The `k` rows of `vectors` of largest inner product for each row of `queries`: `query_id`, `rank`
    (from 1, ties to the smaller id), `vec_id`, `score`.

    Vectors that are null, zero, or hold null or non-finite components take no part on either side, and
    neither do rows without an id. A query's candidates are all vectors of its dimension but those of its
    own id; if these are fewer than `k`, all are returned. Repeated vectors are candidates of their own,
    repeated queries are answered each. Other columns are not read. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    c = F.col
    wide = isinstance(vectors.schema[vector].dataType.elementType, T.DoubleType)
    kind = np.float64 if wide else np.float32
    shape = "array<double>" if wide else "array<float>"

    def blocks(df: DataFrame, rows: int) -> DataFrame:
        return pack(df.select(c(vec_id).cast("bigint").alias("id"), c(vector).cast(shape).alias("v")), rows)

    stages = Stages(spark, "neighbours")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = stages.keep(blocks(vectors, VECTOR_BLOCK), "vectors")
    q = stages.keep(blocks(queries.repartition(max(1, parts // 4), vec_id), QUERY_BLOCK), "queries")
    # Which blocks meet: all of one dimension. These lists hold block names only.
    pairs = q.select(c("block").alias("q"), "size").join(x.select(c("block").alias("x"), "size"), "size")
    pairs = pairs.join(q.select(c("block").alias("q"), c("n").alias("q_n"), c("path").alias("q_path")), "q")
    pairs = pairs.join(x.select(c("block").alias("x"), c("n").alias("x_n"), c("path").alias("x_path")), "x")
    pairs = pairs.select("q", "size", "q_n", "q_path", "x_n", "x_path", "x")
    # Tasks get names alone and read the blocks; one block of vectors stays in hand for the queries that meet it.
    pairs = pairs.repartitionByRange(parts, "x", "q").sortWithinPartitions("x", "q").drop("x")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, q_n, q_path, x_n, x_path in zip(*(x.to_pylist() for x in batch.columns)):
                q_ids, q_data = unpack(q_path, size, q_n, kind)
                x_ids, x_data = per_process("vector block", x_path, lambda: unpack(x_path, size, x_n, kind))  # noqa: B023
                i, j, score = nearest(q_ids, q_data, x_ids, x_data, k)
                yield pa.RecordBatch.from_pydict(
                    {
                        "q": pa.array([name] * len(i), pa.string()),
                        "part": pa.array((i // MERGE_QUERIES).astype(np.int32)),
                        "row": pa.array(i.astype(np.int32)),
                        "query_id": pa.array(q_ids[i]),
                        "vec_id": pa.array(x_ids[j]),
                        "score": pa.array(score),
                    }
                )

    def merge(table: pa.Table) -> pa.Table:
        heaps: dict[tuple[int, int], list] = {}
        for row, query, vec, score in zip(*(table.column(n).to_pylist() for n in ("row", "query_id", "vec_id", "score"))):
            heap, item = heaps.setdefault((row, query), []), (score, -vec)
            if len(heap) < k:
                heapq.heappush(heap, item)
            else:
                heapq.heappushpop(heap, item)
        out = [
            (query, rank, -vec, score)
            for (_, query), heap in heaps.items()
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1)
        ]
        ids, ranks, found, scores = zip(*out)
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(ranks, pa.int32()), pa.array(found, pa.int64()), pa.array(scores, pa.float64())],
            names=["query_id", "rank", "vec_id", "score"],
        )

    best = pairs.mapInArrow(task(multiply), "q string, part int, row int, query_id bigint, vec_id bigint, score double")
    return best.groupBy("q", "part").applyInArrow(grouped(merge), "query_id bigint, rank int, vec_id bigint, score double")
