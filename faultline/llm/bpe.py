"""Byte-level BPE by the tokenizers library from a file of ranks, and its inverse.

A rank file lists byte strings; a merge joins the two neighbours whose joined bytes have the lowest
rank. The tokenizers library works on pairs, so every split of a token into two tokens is given as
a merge, in rank order. Bytes are mapped to printable characters for the library and back.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from faultline.llm.common import per_process, strings, task, text_bytes, text_slices
from faultline.llm.segments import SegmentIds, one_by_one

SLICE_BYTES = 1 << 19
CACHE_SEGMENTS = 500_000


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class ByteCodec:
    """Encodes and decodes columns of text; one per worker process, as `codec` gives it."""

    def __init__(self, rank_file: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        shown = byte_characters()
        show = lambda piece: "".join(shown[b] for b in piece)
        ordered = sorted(ranks, key=ranks.get)
        merges = [
            (show(t[:i]), show(t[i:])) for t in ordered for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE({show(t): ranks[t] for t in ordered}, merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        # The byte table: the bytes of id i are table[at[i] : at[i + 1]].
        by_id = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            by_id[i] = t
        self.at = np.zeros(len(by_id) + 1, np.int64)
        np.cumsum([len(t) for t in by_id], out=self.at[1:])
        self.table = np.frombuffer(b"".join(by_id), np.uint8)
        self.forget(None)

    def forget(self, run: str | None) -> None:
        """Start a run with no encoded segments."""
        self.run, self.segments = run, SegmentIds(one_by_one(self.tokenizer), CACHE_SEGMENTS)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 borders of each row's ids. Each distinct segment is encoded once."""
        data, borders = text_bytes(text)
        starts = segment_starts(data, borders)
        ids, id_borders = self.segments.encode(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts)
        return ids, id_borders[np.searchsorted(starts, borders)]

    def decode(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows, and their n + 1 borders. A character split over ids comes whole again
        since bytes, not characters, are laid end to end."""
        sizes = self.at[ids.astype(np.int64) + 1] - self.at[ids]
        out_ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=out_ends[1:])
        where = np.arange(out_ends[-1]) + np.repeat(self.at[ids] - out_ends[:-1], sizes)
        return self.table[where], out_ends[borders]

    def offsets(self, ids: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character offsets (start, end) of each id in its row. An id that holds a part of a character
        spans that whole character."""
        data, byte_borders = self.decode(ids, borders)
        sizes = self.at[ids.astype(np.int64) + 1] - self.at[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        row = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
        base = heads[byte_borders[:-1]][row]
        # A start inside a character belongs to the character begun before it.
        inside = np.zeros(len(data) + 1, np.int64)
        inside[:-1] = (data & 0xC0) == 0x80
        return heads[starts] - inside[starts] - base, heads[ends] - base


def codec(rank_file: str, pattern: str, run: str | None = None) -> ByteCodec:
    """The worker's tables; segments are kept for one run of the operator only."""
    held = per_process("byte codec", (rank_file, pattern), lambda: ByteCodec(rank_file, pattern))
    if held.run != run:
        held.forget(run)
    return held


def segment_starts(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Where each row's segments begin. A segment is white space and what follows up to the next.

    No match of a split pattern spans a change from other characters to ASCII white space, so each
    segment can be encoded alone. A change after a byte that might end a wide white space character
    is not used.
    """
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = np.zeros(len(data), bool)
    if len(data) > 1:
        plain = (data > 0x20) & (data < 0x7F)
        # The last byte of a two-byte character other than those led by C2, which hold wide spaces.
        two = np.zeros(len(data), bool)
        two[1:] = (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        first[1:] = space[1:] & (plain | two)[:-1]
    inner = borders[borders < len(data)]
    first[inner] = True
    return np.flatnonzero(first)


def encode_decode(
    docs: DataFrame, text: str, rank_file: str, pattern: str, offsets: bool = False
) -> DataFrame:
    """Add `bpe_ids` (binary, little-endian unsigned 32-bit ids), `bpe_n` (ids) and `bpe_text` (binary,
    the bytes that the ids decode to) to every row; with `offsets`, `bpe_starts` and `bpe_ends` as well.

    Null and empty texts have no ids and decode to no bytes. All columns of `docs` stay as they are;
    repeated rows stay repeated. A column of `docs` named like a new one is replaced. Nothing is
    shuffled: each row is encoded and decoded where it is read, a few MB of text at a time.
    """
    new = ["bpe_ids", "bpe_n", "bpe_text", *(["bpe_starts", "bpe_ends"] if offsets else [])]
    kept = docs.drop(*new)
    kinds = [T.BinaryType(), T.LongType(), T.BinaryType(), *[T.ArrayType(T.IntegerType())] * 2]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds))])

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern, name)
        for whole in batches:
            for batch in text_slices(whole, text, SLICE_BYTES):
                ids, borders = bpe.encode(batch.column(batch.schema.get_field_index(text)))
                back, back_borders = bpe.decode(ids, borders)
                columns = [
                    *batch.columns,
                    strings(ids.astype("<u4").view(np.uint8), borders * 4, pa.binary()),
                    pa.array(np.diff(borders)),
                    strings(back, back_borders, pa.binary()),
                ]
                if offsets:
                    columns += [
                        pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(x.astype(np.int32)))
                        for x in bpe.offsets(ids, borders)
                    ]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return kept.mapInArrow(task(run), schema)
