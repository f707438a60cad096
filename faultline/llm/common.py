"""Helpers that several operators share: staging in the cluster's shared folder, Arrow slices, word hashes."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from faultline.session import shared_folder

# ---- staging -------------------------------------------------------------------------------------


def folder_for(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Stages:
    """Tables written between the jobs of one operator, in the folder that all executors share.

    A stage cuts lineage: after it, a lost executor costs a re-read. `drop` deletes stages whose
    readers have finished and lets Spark remove the shuffle files of finished jobs.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = folder_for(spark, what)
        self.n = 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete(self.spark, table.stage_path)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def open_input(path: str):
    """A file of the shared folder as a stream, inside a task, whatever its scheme."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(_uri(path))
    return where.open_input_stream(name)


def open_output(path: str):
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(_uri(path))
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name)


def _uri(path: str) -> str:
    """The path as Arrow names it: Hadoop prints local ones as file:/x, and has names of its own for S3."""
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}"
    return "file://" + path.removeprefix("file:")


def write_file(path: str, data: bytes) -> None:
    with open_output(path) as out:
        out.write(data)


def read_file(path: str) -> bytes:
    with open_input(path) as source:
        return source.read()


def _held() -> dict:
    """What this worker process keeps from task to task."""
    name = "_faultline_held"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("held", {"task": None, "kept": {}, "used": set()})


def per_process(kind: str, key, make: Callable):
    """A value kept by the worker process: the last one of its kind, made anew for another key.

    Tasks bring copies of this package's functions along; a module's own globals would not outlive a task.
    What a whole task did not ask for is dropped before the next one.
    """
    held = _held()
    held["used"].add(kind)
    if kind not in held["kept"] or held["kept"][kind][0] != key:
        held["kept"].pop(kind, None)
        held["kept"][kind] = (key, make())
    return held["kept"][kind][1]


def tidy() -> None:
    """Free what earlier tasks of this worker left behind, once per task.

    Functions that a task brings along refer to each other in circles, and so keep its arrays until Python
    looks for such circles, which it does rarely where many modules are loaded. What is loaded before a
    worker's first task ends is taken out of the search.
    """
    from pyspark import TaskContext

    context, held = TaskContext.get(), _held()
    now = context.taskAttemptId() if context else -1
    if held["task"] == now:
        return
    held["kept"] = {k: v for k, v in held["kept"].items() if k in held["used"]}
    held["used"] = set()
    gc.collect()
    if held["task"] is None:
        gc.freeze()
    held["task"] = now
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def task(run: Callable) -> Callable:
    """`run`, for mapInArrow, in a tidy worker."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        yield from run(batches)

    return tidied


def grouped(run: Callable[[pa.Table], pa.Table]) -> Callable:
    """`run`, for applyInArrow on a group, in a tidy worker."""

    def tidied(table: pa.Table) -> pa.Table:
        tidy()
        return run(table)

    return tidied


def cogrouped(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable:
    """`run`, for applyInArrow on two groups, in a tidy worker."""

    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        tidy()
        return run(left, right)

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if `df` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Enough partitions for `rows`, and not fewer than the session deals out by default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


# ---- Arrow ---------------------------------------------------------------------------------------


def text_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of at most `most` text bytes; one longer row stands alone."""
    i = batch.schema.get_field_index(column)
    text = batch.column(i)
    if batch.num_rows == 0:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the n + 1 row borders; null is empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    kind = np.int64 if wide else np.int32
    buffers = text.buffers()
    if len(text) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(buffers[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def strings(data: np.ndarray, borders: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The inverse of `text_bytes`, without a copy per row."""
    kind = kind or pa.string()
    width = np.int64 if kind in (pa.large_string(), pa.large_binary()) else np.int32
    return pa.Array.from_buffers(
        kind,
        len(borders) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(borders, width)), pa.py_buffer(np.ascontiguousarray(data))],
    )


# ---- words ---------------------------------------------------------------------------------------

_BYTES = np.arange(256)
#: Bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z, and whatever is not ASCII.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def word_spans(data: np.ndarray, borders: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the n + 1 borders of each row's words."""
    inside = is_word[data]
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0], last[-1] = True, True
        np.logical_not(inside[:-1], out=first[1:])
        np.logical_not(inside[1:], out=last[:-1])
        inner = borders[(borders > 0) & (borders < len(data))]
        first[inner] = True
        last[inner - 1] = True
        first &= inside
        last &= inside
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, borders)


_RADIX = 0x9E3779B97F4A7C15 | 1
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64, at least up to the n-th."""
    held = per_process("powers", None, lambda: {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    if len(held["up"]) < n:
        size = -(-n // 65536) * 65536
        for name, base in (("up", _RADIX), ("down", pow(_RADIX, -1, 1 << 64))):
            out, step = np.ones(1, np.uint64), base
            while len(out) < size:
                out = np.concatenate([out, out[: size - len(out)] * np.uint64(step)])
                step = step * step % (1 << 64)
            held[name] = out
    return held["up"][:n], held["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a polynomial of the bytes, by running sums."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def chained(h: np.ndarray, n: int, radix: int) -> np.ndarray:
    """Hash of each run of `n` neighbours: a polynomial over h[i : i + n]; len(h) - n + 1 values."""
    count = max(0, len(h) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= np.uint64(radix)
        out += h[k : k + count]
    return mix(out)
