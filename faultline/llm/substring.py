"""Exact substring deduplication with fixed-block anchors.

Every document is cut into non-overlapping blocks of half a window; any window of a document holds
at least one of its blocks whole, its anchor. So two equal windows meet where a rolling run of words
of one equals a block of the other:

1. Documents are packed into chunks of a few MB, kept as rows of a staged table.
2. Each chunk sends the hashes of its rolling runs, each distinct one once, split by hash bucket; those
   that are blocks carry a mark. A bucket finds the hashes that are a block somewhere and occur twice.
3. Chunks get their hits back as bit sets and extend them: each window around a hit is hashed whole
   (96 bits) and sent once per chunk with its first place.
4. A bucket keeps each window's first place in the corpus; all other places go back as bit sets, and
   runs of such windows, maximal exact repeats, are cut out of the text.

Since a chunk sends a hash once, a passage shared by a third of all documents costs one entry a chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import (
    NOT_SPACE,
    Stages,
    chained,
    cogrouped,
    grouped,
    mix,
    partitions_for,
    span_hashes,
    strings,
    task,
    text_bytes,
    text_slices,
    word_spans,
)

CHUNK_BYTES = 4 << 20
#: Words that one bucket of the first exchange should get.
BUCKET_WORDS = 1 << 20
R10, R20, R20B = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


# ---- chunks --------------------------------------------------------------------------------------


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def pack(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (chunk, words, data) of a few MB of documents each, cut where they are read."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            words = len(word_spans(*text_bytes(batch.column(1)), NOT_SPACE)[0])
            return pa.RecordBatch.from_pydict(
                {"chunk": [uuid.uuid4().hex], "words": pa.array([words], pa.int64()), "data": pa.array([_packed(batch)], pa.binary())}
            )

        for whole in batches:
            for batch in text_slices(whole, "text", CHUNK_BYTES):
                mine = len(text_bytes(batch.column(1))[0])
                if held and size + mine > CHUNK_BYTES:
                    yield flush()
                    held, size = [], 0
                held.append(batch)
                size += mine
        if held:
            yield flush()

    return rows.mapInArrow(task(run), "chunk string, words bigint, data binary")


class Chunk:
    """The words of a chunk and their hashes, the same each time it is read."""

    def __init__(self, data: bytes, window: int):
        batch = _unpacked(data)
        self.window, self.block = window, window // 2
        self.ids = batch.column(0)
        self.bytes, self.borders = text_bytes(batch.column(1))
        self.starts, self.ends, self.row = word_spans(self.bytes, self.borders, NOT_SPACE)
        self.word = span_hashes(self.bytes, self.starts, self.ends)
        n = len(self.word)
        # Words left in the document from each word on.
        lengths = np.diff(self.row)
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.pos = np.arange(n) - self.row[self.doc]
        self.left = self.row[self.doc + 1] - np.arange(n)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the rolling runs, their hashes sorted and once each, the place's index in these, and
        flags: 1 for a block, 2 for two places in this chunk."""
        places = np.flatnonzero(self.left >= self.block)
        h = chained(self.word, self.block, R10)[places]
        keys, where, counts = np.unique(h, return_inverse=True, return_counts=True)
        flags = (counts > 1).astype(np.uint8) * 2
        flags[where[self.pos[places] % self.block == 0]] |= 1
        return places, keys, where, flags

    def windows(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that hold a hit run: places in corpus order, hashes (two parts), and the index of the
        first equal window of this chunk."""
        n = len(self.word)
        seen = np.zeros(n + 1, np.int64)
        np.cumsum(hit, out=seen[1:])
        places = np.flatnonzero(self.left >= self.window)
        places = places[seen[places + self.window - self.block + 1] > seen[places]]
        a = chained(self.word, self.window, R20)[places]
        b = chained(self.word, self.window, R20B)[places].astype(np.uint32)
        rank = self.doc_rank()
        order = np.lexsort((places, rank[self.doc[places]], b, a))
        a, b, places = a[order], b[order], places[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return places, a, b, np.flatnonzero(new)

    def doc_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """A document's order: its id, nulls first, then a hash of its text for rows that share an id."""
        ids = self.ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        sums = mix(np.bincount(self.doc, weights=None, minlength=len(ids)).astype(np.uint64))
        at = np.flatnonzero(np.diff(self.row))
        if len(at):
            sums[at] ^= np.add.reduceat(self.word * (self.pos.astype(np.uint64) * np.uint64(2) + np.uint64(1)), self.row[at])
        return ids, sums

    def doc_rank(self) -> np.ndarray:
        ids, sums = self.doc_keys()
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((sums, ids))] = np.arange(len(ids))
        return rank


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of the numbers, all first bytes first: like bytes stand together and pack well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _by_bucket(chunk: str, buckets: np.ndarray, total: int, blob) -> Iterator[pa.RecordBatch]:
    """One row per bucket that has entries; `buckets` ascends."""
    cuts = np.searchsorted(buckets, np.arange(total + 1))
    filled = np.flatnonzero(np.diff(cuts))
    for at in range(0, len(filled), 512):
        part = filled[at : at + 512]
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(part, pa.int32()),
                "chunk": pa.array([chunk] * len(part), pa.string()),
                "n": pa.array(np.diff(cuts)[part], pa.int32()),
                "data": pa.array([blob(cuts[b], cuts[b + 1]) for b in part], pa.binary()),
            }
        )


_BLOBS = "bucket int, chunk string, n int, data binary"


def _returned(table: pa.Table, keep: np.ndarray, kind: int) -> pa.Table:
    """The marks of each blob of a bucket as a bit set, for the blobs that have any."""
    n = table.column("n").to_numpy()
    ends = np.cumsum(n)
    rows, bits = [], []
    for i, (end, size) in enumerate(zip(ends, n)):
        part = keep[end - size : end]
        if part.any():
            rows.append(i)
            bits.append(np.packbits(part).tobytes())
    found = table.take(pa.array(rows, pa.int64()))
    return pa.table(
        {
            "chunk": found.column("chunk"),
            "kind": pa.array([kind] * len(rows), pa.int32()),
            "bucket": found.column("bucket"),
            "n": found.column("n"),
            "bits": pa.array(bits, pa.binary()),
        }
    )


_MARKS = "chunk string, kind int, bucket int, n int, bits binary"


def _marks(marks: pa.Table, kind: int, buckets: np.ndarray, total: int) -> np.ndarray:
    """A chunk's bit sets of one kind laid over its entries, which ascend by bucket."""
    cuts = np.searchsorted(buckets, np.arange(total + 1))
    out = np.zeros(len(buckets), bool)
    for k, b, n, bits in zip(*(marks.column(c).to_pylist() for c in ("kind", "bucket", "n", "bits"))):
        if k == kind:
            out[cuts[b] : cuts[b] + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


# ---- the operator --------------------------------------------------------------------------------


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Remove every word that lies in a window of `window` words (even, 4 or more) that also starts earlier.

    Words are runs of characters other than ASCII white space. Earlier means in a document of smaller
    id, or at an earlier place of the same document; windows are judged on the texts as given. Returns
    a row per row of `docs`: the id (as bigint), `n_words`, `n_removed`, `kept` (the words that stay,
    joined by single spaces) and `removed` (array of (start, end) word spans, end exclusive).

    A null text has no words. A null id comes before all others; rows that share an id are ordered by a
    hash of their text, so of repeated rows one keeps its words. Texts shorter than a window stay whole.
    Other columns of `docs` are not read. An empty table gives an empty result.
    """
    if window < 4 or window % 2:
        raise ValueError("window must be even and 4 or more")
    spark = docs.sparkSession
    stages = Stages(spark, "substring")
    chunks = stages.keep(pack(docs, doc_id, text), "chunks")
    words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    bits = max(8, (-(-words // BUCKET_WORDS)).bit_length())
    total = 1 << bits
    low = np.uint64(64 - bits - 32)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, keys, _, flags = Chunk(data.as_buffer(), window).probes()
                short = keys >> low
                yield from _by_bucket(
                    name, _bucket(keys, bits), total, lambda a, b: _planes(short[a:b], 4) + np.packbits(flags[a:b] & 1).tobytes() + np.packbits(flags[a:b] >> 1).tobytes()
                )

    def match(table: pa.Table) -> pa.Table:
        keys, block, twice = [], [], []
        for n, data in zip(table.column("n").to_pylist(), table.column("data").combine_chunks()):
            view = memoryview(data.as_buffer())
            keys.append(_numbers(view, n, 4).astype(np.uint32))
            step = -(-n // 8)
            for out, at in ((block, 4 * n), (twice, 4 * n + step)):
                out.append(np.unpackbits(np.frombuffer(view[at : at + step], np.uint8), count=n).astype(bool))
        key, block, twice = (np.concatenate(x) for x in (keys, block, twice))
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        shared = np.diff(np.append(first, len(key))) > 1
        hit = (shared | np.logical_or.reduceat(twice[order], first)) & np.logical_or.reduceat(block[order], first)
        keep = np.zeros(len(key), bool)
        keep[order] = hit[np.cumsum(new) - 1]
        return _returned(table, keep, 0)

    def hits_of(chunk: Chunk, marks: pa.Table) -> np.ndarray:
        places, keys, where, _ = chunk.probes()
        hit = np.zeros(len(chunk.word), bool)
        hit[places] = _marks(marks, 0, _bucket(keys, bits), total)[where]
        return hit

    def extend(left: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        for name, data in zip(left.column("chunk").to_pylist(), left.column("data").combine_chunks()):
            chunk = Chunk(data.as_buffer(), window)
            places, a, b, first = chunk.windows(hits_of(chunk, marks))
            ids, sums = chunk.doc_keys()
            a, b, at = a[first], b[first], places[first]
            ids, sums, pos = ids[chunk.doc[at]].view(np.uint64), sums[chunk.doc[at]], chunk.pos[at]
            out += _by_bucket(
                name, _bucket(a, bits), total,
                lambda i, j: b"".join(_planes(x[i:j], w) for x, w in ((a, 8), (b, 4), (ids, 8), (sums, 4), (pos, 5))),
            )
        return pa.Table.from_batches(out) if out else EMPTY_BLOBS

    def earliest(table: pa.Table) -> pa.Table:
        parts = [[], [], [], [], []]
        for n, data in zip(table.column("n").to_pylist(), table.column("data").combine_chunks()):
            view, at = memoryview(data.as_buffer()), 0
            for out, width in zip(parts, (8, 4, 8, 4, 5)):
                out.append(_numbers(view[at:], n, width))
                at += n * width
        a, b, ids, sums, pos = (np.concatenate(x) for x in parts)
        # Repeated rows agree in all of these: then one chunk goes before the other in every bucket.
        names = table.column("chunk").to_numpy()
        tie = np.repeat(np.unique(names, return_inverse=True)[1], table.column("n").to_numpy())
        order = np.lexsort((tie, pos, sums, ids.view(np.int64), b, a))
        later = np.zeros(len(a), bool)
        later[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        return _returned(table, later, 1)

    def cut(left: pa.Table, marks: pa.Table) -> pa.Table:
        out = [EMPTY_DOCS]
        for data in left.column("data").combine_chunks():
            chunk = Chunk(data.as_buffer(), window)
            places, a, b, first = chunk.windows(hits_of(chunk, marks))
            later = np.ones(len(places), bool)
            later[first] = _marks(marks, 1, _bucket(a[first], bits), total)
            out.append(_without(chunk, places[later]))
        return pa.concat_tables(out)

    by = chunks.select("chunk", "data")
    buckets = partitions_for(spark, words, BUCKET_WORDS)
    probes = by.mapInArrow(task(probe), _BLOBS).repartition(buckets, "bucket")
    hits = stages.keep(probes.groupBy("bucket").applyInArrow(grouped(match), _MARKS), "hits")
    stages.drop()
    by_chunk = by.groupBy("chunk")
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(cogrouped(extend), _BLOBS).repartition(buckets, "bucket")
    later = stages.keep(windows.groupBy("bucket").applyInArrow(grouped(earliest), _MARKS), "later")
    stages.drop()
    marks = hits.unionByName(later)
    return by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(cogrouped(cut), _DOCS).withColumnRenamed("id", doc_id)


_DOCS = "id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_DOCS_ARROW = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(_SPAN))]
)
EMPTY_DOCS = _DOCS_ARROW.empty_table()
EMPTY_BLOBS = pa.schema([("bucket", pa.int32()), ("chunk", pa.string()), ("n", pa.int32()), ("data", pa.binary())]).empty_table()


def _without(chunk: Chunk, places: np.ndarray) -> pa.Table:
    """A chunk's documents without the words of the windows that start at `places`."""
    n = len(chunk.word)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, places, 1)
    np.add.at(edges, places + chunk.window, -1)
    gone = np.cumsum(edges[:-1]) > 0
    kept = np.flatnonzero(~gone)
    # Each kept word goes with the white space after it, as one space; a document's last one without.
    data = np.where(NOT_SPACE[chunk.bytes], chunk.bytes, np.uint8(0x20)) if len(chunk.bytes) else chunk.bytes
    last = np.ones(len(kept), bool)
    last[:-1] = chunk.doc[kept[1:]] != chunk.doc[kept[:-1]]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[chunk.starts[kept]] += 1
    stop = chunk.ends[kept] + ~last
    inside[stop] -= 1
    stays = np.cumsum(inside[:-1], dtype=np.int8) > 0
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stays, out=sizes[1:])
    # Spans of removed words, in words of their document.
    mark = np.zeros(n + 2, bool)
    mark[1:-1] = gone
    new_doc = np.zeros(n + 1, bool)
    new_doc[chunk.row] = True
    begins = np.flatnonzero(mark[1:-1] & (~mark[:-2] | new_doc[:-1]))
    finish = np.flatnonzero(mark[1:-1] & (~mark[2:] | new_doc[1:])) + 1
    base = chunk.row[chunk.doc[begins]]
    spans = pa.StructArray.from_arrays(
        [pa.array((begins - base).astype(np.int32)), pa.array((finish - base).astype(np.int32))], fields=list(_SPAN)
    )
    removed = np.zeros(n + 1, np.int64)
    np.cumsum(gone, out=removed[1:])
    return pa.table(
        [
            chunk.ids,
            pa.array(np.diff(chunk.row)),
            pa.array(np.diff(removed[chunk.row])),
            strings(data[stays], sizes[chunk.borders]),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, chunk.row).astype(np.int32)), spans),
        ],
        schema=_DOCS_ARROW,
    )
