"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of words, packed into blocks of bounded size in the shared folder. Each
shard, a few MB of documents, is indexed where it is read: its words as symbols of a block's vocabulary
(other words break the text), suffixes sorted, the last column as a wavelet matrix with running bit
counts, suffix positions sampled. All windows of the block are searched backwards at once, occurrences
are located by walking to a sampled position, and their spans are merged per document. Nothing is
shuffled, and no task holds more than one shard and one block.
"""

from __future__ import annotations

import io
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import (
    ALNUM,
    LOWER,
    folder_for,
    open_input,
    open_output,
    per_process,
    span_hashes,
    task,
    text_bytes,
    text_slices,
    word_spans,
)

SHARD_BYTES = 2 << 20
BLOCK_BYTES = 4 << 20
#: Every so many text positions the suffix position is kept.
SAMPLE = 8


# ---- the benchmark -------------------------------------------------------------------------------


def _words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the borders of each row's words; the last value is the count."""
    data, borders = text_bytes(text)
    data = LOWER[data]
    starts, ends, row = word_spans(data, borders, ALNUM)
    return span_hashes(data, starts, ends), row, np.diff(row)


def _pack_block(ids: list[str], text: pa.Array, window: int) -> bytes | None:
    """Distinct windows as rows of word symbols (1 on; 0 pads at the end), with the items that hold each."""
    words, row, count = _words(text)
    vocabulary, symbol = np.unique(words, return_inverse=True)
    size = np.where(count == 0, 0, np.minimum(count, window))
    windows = np.where(count == 0, 0, count - size + 1)
    item = np.repeat(np.arange(len(count)), windows)
    if not len(item):
        return None
    first = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows) + row[item]
    grid = np.zeros((len(item), window), np.int32)
    for k in range(window):
        has = k < size[item]
        grid[has, k] = symbol[first[has] + k] + 1
    rows, which = np.unique(grid, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), item]), axis=1)
    borders = np.searchsorted(pairs[0], np.arange(len(rows) + 1))
    out = io.BytesIO()
    np.savez(out, vocabulary=vocabulary, rows=rows, items=pairs[1], borders=borders, ids=np.array(ids, dtype=str))
    return out.getvalue()


def write_blocks(items: DataFrame, item_id: str, text: str, window: int, folder: str) -> list[str]:
    """Write the benchmark as block files below `folder`; returns their paths."""
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(text).cast("string").alias("text")
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", BLOCK_BYTES):
                data = _pack_block(batch.column(0).to_pylist(), batch.column(1), window)
                if data:
                    path = f"{folder}/{uuid.uuid4().hex}.npz"
                    with open_output(path) as out:
                        out.write(data)
                    yield pa.RecordBatch.from_pydict({"path": [path]})

    dealt = rows.repartition(max(1, -(-total // BLOCK_BYTES)), F.xxhash64("id", "text"))
    return sorted(r.path for r in dealt.mapInArrow(task(run), "path string").collect())


class Block:
    def __init__(self, path: str):
        with open_input(path) as source:
            held = np.load(io.BytesIO(source.read()))
        self.vocabulary, self.rows, self.items, self.borders = (held[k] for k in ("vocabulary", "rows", "items", "borders"))
        self.ids = held["ids"].tolist()
        self.length = (self.rows > 0).sum(axis=1)
        # A table of 16 hash bits spares most lookups of words that the benchmark lacks.
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.vocabulary >> np.uint64(48)] = True

    def symbols(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int32)
        some = np.flatnonzero(self.maybe[words >> np.uint64(48)])
        at = np.searchsorted(self.vocabulary, words[some])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words[some]
        out[some[known]] = at[known] + 1
        return out


def _block(path: str) -> Block:
    return per_process("benchmark block", path, lambda: Block(path))


# ---- the index -----------------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of any symbol at any place of a sequence, by one running bit count per bit of the symbols."""

    def __init__(self, values: np.ndarray, bits: int):
        self.ones, self.zeros, self.bits = [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(values) - int(count[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        start = np.zeros_like(at)
        for k in range(self.bits):
            high = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            a, b = ones[start], ones[at]
            start = np.where(high, self.zeros[k] + a, start - a)
            at = np.where(high, self.zeros[k] + b, at - b)
        return at - start


class FMIndex:
    """Backward search over one sequence of symbols in which 0 breaks the text; it begins and ends with 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        # Breaks are told apart by their place, so that no two suffixes are equal.
        breaks = np.cumsum(text == 0)
        rank = np.where(text == 0, breaks - 1, breaks[-1] + text).astype(np.int64)
        step = 1
        order = np.argsort(rank, kind="stable")
        while True:
            new = np.ones(n, bool)
            new[1:] = rank[order[1:]] != rank[order[:-1]]
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(new) - 1
            if new.all():
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = dense[step:] + 1
            rank = dense * (n + 1) + after
            order = np.argsort(rank, kind="stable")
            step *= 2
        last = text[order - 1]  # place 0 holds a break, and so does the place before it
        self.places = WaveletMatrix(last.astype(np.int32), max(1, int(symbols).bit_length()))
        self.last = last
        self.first = np.searchsorted(text[order], np.arange(symbols + 2))
        kept = (order % SAMPLE == 0) | (last == 0)
        self.sampled = kept
        self.sample_at = np.cumsum(kept) - 1
        self.samples = order[kept]

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.places.rank(symbol, row)

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.last), np.int64)
        for k in range(rows.shape[1] - 1, -1, -1):
            on = np.flatnonzero((k < length) & (low < high))
            low[on], high[on] = self._step(rows[on, k], low[on]), self._step(rows[on, k], high[on])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back to a sampled one, counting steps."""
        row, out, steps = row.copy(), np.zeros(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            done = self.sampled[row[todo]]
            at = todo[done]
            out[at] = self.samples[self.sample_at[row[at]]] + steps
            todo = todo[~done]
            row[todo] = self._step(self.last[row[todo]], row[todo])
            steps += 1
        return out


def occurrences(words: np.ndarray, row: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word place, window) of every occurrence of a window of the block in the shard."""
    symbol = block.symbols(words)
    # Runs of benchmark words as long as the shortest window; no window lies anywhere else.
    new = np.zeros(len(words) + 1, bool)
    new[row] = True
    known = np.append(symbol > 0, False)
    begins = np.flatnonzero(known & (~np.append(False, known[:-1]) | new))
    stops = np.flatnonzero(known[:-1] & (~known[1:] | new[1:])) + 1
    long = stops - begins >= block.length.min()
    begins, size = begins[long], (stops - begins)[long]
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The runs laid out with a break before each and at the end; `source` leads back to the words.
    head = np.cumsum(size + 1) - size
    text = np.zeros(int(size.sum()) + len(size) + 1, np.int32)
    source = np.zeros(len(text), np.int64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    to = inside + np.repeat(head, size)
    source[to] = inside + np.repeat(begins, size)
    text[to] = symbol[source[to]]
    index = FMIndex(text, len(block.vocabulary))
    low, high = index.search(block.rows, block.length)
    found = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(low)), found)
    suffix = np.arange(int(found.sum())) + np.repeat(low - (np.cumsum(found) - found), found)
    return source[index.locate(suffix)], window


# ---- the operator --------------------------------------------------------------------------------

_NEW = {"n_words": "bigint", "n_hit": "bigint", "items": "array<string>", "spans": "array<struct<start:int,end:int>>"}
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


#: Slices that are judged against one benchmark block before the next is read.
SLICES = 8


class _Slice:
    """A shard's words and what has been found in them."""

    def __init__(self, batch: pa.RecordBatch, text: str):
        self.words, self.row, self.count = _words(batch.column(batch.schema.get_field_index(text)))
        self.edges = np.zeros(len(self.words) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in self.count]

    def search(self, block: Block) -> None:
        at, window = occurrences(self.words, self.row, block)
        np.add.at(self.edges, at, 1)
        np.add.at(self.edges, at + block.length[window], -1)
        doc = np.searchsorted(self.row, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
            self.items[d].update(block.ids[i] for i in block.items[block.borders[w] : block.borders[w + 1]])


def _judged(batches: list[pa.RecordBatch], text: str, paths: list[str]) -> Iterator[list[pa.Array]]:
    """The new columns of some slices: each block is read once for all of them."""
    slices = [_Slice(batch, text) for batch in batches]
    for path in paths:
        block = _block(path)
        for one in slices:
            one.search(block)
    for one in slices:
        yield _columns(one.words, one.row, one.count, one.edges, one.items)


def _columns(words: np.ndarray, row: np.ndarray, count: np.ndarray, edges: np.ndarray, items: list[set[str]]) -> list[pa.Array]:
    hit = np.cumsum(edges[:-1]) > 0
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    new = np.zeros(len(words) + 1, bool)
    new[row] = True
    begins = np.flatnonzero(hit & (~np.append(False, hit[:-1])[: len(hit)] | new[:-1]))
    stops = np.flatnonzero(hit & (~np.append(hit[1:], False)[: len(hit)] | new[1:])) + 1
    base = row[np.searchsorted(row, begins, side="right") - 1]
    spans = pa.StructArray.from_arrays(
        [pa.array((begins - base).astype(np.int32)), pa.array((stops - base).astype(np.int32))], fields=list(_SPAN)
    )
    return [
        pa.array(count),
        pa.array(np.diff(total[row])),
        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, row).astype(np.int32)), spans),
    ]


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    prefix: str = "",
) -> DataFrame:
    """Every row of `docs`, all columns, with `n_words`, `n_hit` (words inside an occurrence of a benchmark
    window), `items` (ids of the items whose windows occur, sorted strings, once each) and `spans` (merged
    word spans to remove, end exclusive); `prefix` goes before these names.

    A window is `window` consecutive words of an item; a shorter item is one window. Words are runs of
    a-z, 0-9 and characters outside ASCII, after A-Z are lower-cased. Null or empty texts have no words,
    so nothing hits them, and items without words have no window. A null item id counts as an empty
    string; rows that share an item id count as one item. Repeated rows stay. A column of `docs` named
    like a new one is replaced. An empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    folder = folder_for(spark, "benchmark")
    paths = write_blocks(benchmark, item_id, item_text, window, folder)
    names = [prefix + name for name in _NEW]
    kept = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One block stays with the worker; only where there are more do slices wait for each other.
        most = SLICES if len(paths) > 1 else 1
        slices = (batch for whole in batches for batch in text_slices(whole, text, SHARD_BYTES))
        while held := list(itertools.islice(slices, most)):
            for batch, new in zip(held, _judged(held, text, paths)):
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    return kept.mapInArrow(task(run), f"{schema}, " + ", ".join(f"`{prefix}{name}` {kind}" for name, kind in _NEW.items()))


def is_contaminated(n_words="n_words", n_hit="n_hit"):
    """A twentieth of the words or more lie in benchmark windows."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))
