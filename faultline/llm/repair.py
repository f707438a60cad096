"""Token ids in Re-Pair compressed shard files, with random access.

A shard holds the ids of consecutive documents. Pairs of neighbours that occur often are replaced by new
symbols, all frequent pairs of a round at once from left to right, until no pair is frequent. The file
keeps the rules, how many ids each stands for, the symbols, and at every so many symbols the number of ids
before, so any range of ids can be decoded from the nearest mark.

File layout, little-endian: the magic text, seven 64-bit numbers (documents, ids, base, rules, symbols,
bytes per symbol, symbols per mark), then document ids (int64), validity of these (uint8), first id of
each document and the end (int64), rules (two uint32 each), ids per rule (int64), marks (int64), symbols.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

if TYPE_CHECKING:
    from tokenizers import Tokenizer

from faultline.llm.common import (
    LOWER,
    NOT_SPACE,
    Stages,
    open_input,
    open_output,
    per_process,
    strings,
    task,
    text_bytes,
    text_slices,
    word_spans,
)
from faultline.llm.segments import Encode, SegmentIds, many_at_once

SHARD_BYTES = 4 << 20
#: Text that is encoded at once.
SLICE_BYTES = 1 << 20
MAGIC = b"RePair01"
MARK_EVERY = 4096
#: A pair is frequent if it occurs so often in a shard, whatever the shard's size.
FREQUENT = 16


# ---- the grammar ---------------------------------------------------------------------------------


def compress(ids: np.ndarray, least: int = FREQUENT) -> tuple[int, np.ndarray, np.ndarray]:
    """(first new symbol, rules as (left, right) rows, symbols); in the end no pair occurs `least` times."""
    base = int(ids.max()) + 1 if len(ids) else 0
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    free = base
    while len(seq) > 1:
        key = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]
        # Few pairs are frequent: count by hash first, and exactly only what stands in full buckets.
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int32)
        full = np.bincount(slot, minlength=1 << 18) >= least
        at = np.flatnonzero(full[slot])
        pairs, code, count = np.unique(key[at], return_inverse=True, return_counts=True)
        often = count >= least
        hit = often[code]
        at, code = at[hit], code[hit]
        if not len(at):
            break
        # Of overlapping hits every second one is taken, from the left of each run of hits.
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > 1
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, code = at[take], code[take]
        used, symbol = np.unique(code, return_inverse=True)
        rules.append(np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        seq[at] = (symbol + free).astype(np.uint32)
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        free += len(used)
    return base, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), seq


def rule_sizes(base: int, rules: np.ndarray) -> np.ndarray:
    sizes = np.ones(len(rules), np.int64)
    left, right = rules[:, 0].astype(np.int64) - base, rules[:, 1].astype(np.int64) - base
    for k in range(len(rules)):  # a rule names earlier ones only
        sizes[k] = (sizes[left[k]] if left[k] >= 0 else 1) + (sizes[right[k]] if right[k] >= 0 else 1)
    return sizes


def expand(symbols: np.ndarray, base: int, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: rules are undone from the last generation on."""
    out = symbols.astype(np.uint32)
    while len(out) and (over := out >= base).any():
        size = over + 1
        begin = np.cumsum(size) - size
        wide = np.empty(int(size.sum()), np.uint32)
        wide[begin[~over]] = out[~over]
        pair = rules[out[over] - base]
        wide[begin[over]], wide[begin[over] + 1] = pair[:, 0], pair[:, 1]
        out = wide
    return out


# ---- files ---------------------------------------------------------------------------------------


def write_shard(path: str, doc_ids: pa.Array, ids: np.ndarray, borders: np.ndarray) -> None:
    base, rules, symbols = compress(ids)
    sizes = rule_sizes(base, rules)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    each = np.ones(len(symbols), np.int64)
    over = symbols >= base
    each[over] = sizes[symbols[over] - base]
    before = np.cumsum(each) - each
    head = np.array([len(doc_ids), len(ids), base, len(rules), len(symbols), width, MARK_EVERY], "<i8")
    valid = np.asarray(doc_ids.is_valid(), dtype=np.uint8)
    numbers = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    with open_output(path) as out:
        for part in (
            head, numbers, valid, borders.astype("<i8"), rules.astype("<u4"), sizes.astype("<i8"),
            before[::MARK_EVERY].astype("<i8"), symbols.astype(f"<u{width}"),
        ):
            out.write(MAGIC + part.tobytes() if part is head else part.tobytes())


class Shard:
    """A shard file, open for whole or partial decoding."""

    def __init__(self, path: str):
        with open_input(path) as source:
            data = source.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{path} is no shard file")
        self.docs, self.n, self.base, rules, symbols, width, self.every = np.frombuffer(data, "<i8", 7, 8).tolist()
        at = 64
        parts = []
        for kind, count in (("<i8", self.docs), ("u1", self.docs), ("<i8", self.docs + 1), ("<u4", 2 * rules), ("<i8", rules), ("<i8", -(-symbols // self.every)), (f"<u{width}", symbols)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        if at != len(data):
            raise ValueError(f"{path} is cut short or too long")
        numbers, valid, self.borders, rules_flat, self.sizes, self.marks, self.symbols = parts
        self.rules = rules_flat.reshape(-1, 2)
        self.doc_ids = pa.array(numbers, pa.int64(), mask=valid == 0)

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.base, self.rules)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, decoding only from the mark before `start` to the mark after `stop`."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.marks, start, side="right")) - 1
        b = int(np.searchsorted(self.marks, stop, side="left"))
        part = expand(self.symbols[a * self.every : b * self.every], self.base, self.rules)
        return part[start - self.marks[a] : stop - self.marks[a]]


# ---- the operator --------------------------------------------------------------------------------


def _words(tokenizer_file: str, run: str | None) -> SegmentIds:
    """Encoded words of one run of the operator: another run encodes its own."""
    from tokenizers import Tokenizer

    return per_process("word ids", (tokenizer_file, run), lambda: SegmentIds(word_ids(Tokenizer.from_file(tokenizer_file))))


#: Lower-case letters that no normal form changes and no split pattern cuts.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")


def word_ids(tokenizer: Tokenizer) -> Encode:
    """Ids of words: those of plain letters skip the tokenizer's normalizer and split pattern, which leave
    them as they are, and end where an id with the model's word end stands."""
    from tokenizers import Tokenizer, pre_tokenizers

    suffix, general = tokenizer.model.end_of_word_suffix, many_at_once(tokenizer)
    if not suffix:
        return general
    short = Tokenizer(tokenizer.model)
    short.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((_PLAIN.fullmatch(t) is not None for t in texts), bool, len(texts))
        if not plain.any():
            return general(texts)
        simple = [t for t, is_plain in zip(texts, plain) if is_plain]
        found = short.encode_batch_fast([" ".join(simple[i : i + 64]) for i in range(0, len(simple), 64)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        last = np.flatnonzero(ends_word[ids])
        if len(last) != len(simple):
            raise ValueError("the tokenizer's words do not end in its word end")
        sizes = np.zeros(len(texts), np.int32)
        sizes[plain] = np.diff(last, prepend=-1)
        if plain.all():
            return ids, sizes
        other_ids, sizes[~plain] = general([t for t, is_plain in zip(texts, plain) if not is_plain])
        of_plain = np.repeat(plain, sizes)
        out = np.empty(len(of_plain), np.uint32)
        out[of_plain], out[~of_plain] = ids, other_ids
        return out, sizes

    return encode


_B = np.arange(256)
_LETTER = ((_B >= 0x41) & (_B <= 0x5A)) | ((_B >= 0x61) & (_B <= 0x7A))
#: The bar is left out: special tokens are written with bars and must stay whole.
_MARK = (_B > 0x20) & (_B < 0x7F) & ~_LETTER & (_B != ord("|"))


def word_pieces(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of words, and the borders of each row's pieces.

    Letters and ASCII marks or digits are never joined, so words are cut where one follows the other;
    not between an apostrophe and a letter, which may be a shortened word.
    """
    starts, ends, row = word_spans(data, borders, NOT_SPACE)
    if not len(starts):
        return starts, ends, row
    letter, mark = _LETTER[data], _MARK[data]
    after = letter.copy()
    after[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    cut = np.zeros(len(data), bool)
    cut[1:] = (after[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != ord("'")) & letter[1:])
    cut[borders[:-1][borders[:-1] < len(data)]] = False
    first = cut.copy()
    first[starts] = True
    last = np.zeros(len(data) + 1, bool)
    last[ends] = True
    last[:-1] |= cut
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last), np.searchsorted(starts, borders)


def _lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, which the tokenizer would do anyway, but in pieces with a bar (special tokens)."""
    out = LOWER[data]
    for k in np.unique(np.searchsorted(starts, np.flatnonzero(data == ord("|")), side="right") - 1):
        out[starts[k] : ends[k]] = data[starts[k] : ends[k]]
    return out


def encode_words(text: pa.Array, tokenizer_file: str, end_id: int, run: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each with `end_id` after it, and the borders. For tokenizers that lower-case, drop
    white space and join neither words over it nor letters with marks: each distinct piece is encoded once in a
    `run`, in a worker."""
    words, parts, sizes = _words(tokenizer_file, run), [], []
    for batch in text_slices(pa.RecordBatch.from_arrays([text], ["text"]), "text", SLICE_BYTES):
        data, borders = text_bytes(batch.column(0))
        starts, ends, row = word_pieces(data, borders)
        ids, word_borders = words.encode(_lowered(data, starts, ends), starts, ends)
        at = word_borders[row[1:]]
        parts.append(np.insert(ids, at, np.uint32(end_id)))
        sizes.append(np.diff(word_borders[row]) + 1)
    borders = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.concatenate(sizes) if sizes else [], out=borders[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), borders


def write_shards(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode the documents into shard files below `folder`, in ascending id order over all files.

    Returns the staged list of files: `part`, `shard` (their order), `path`, `docs`, `ids`. Only files of
    tasks that were committed are listed. A null text has no ids but the end id; null ids come first; rows
    that share an id stand side by side. Other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        for batch in _regroup(batches):
            ids, borders = encode_words(batch.column(1), tokenizer_file, end_id, name)
            path = f"{folder}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.ids"
            write_shard(path, batch.column(0), ids, borders)
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [path], "docs": [batch.num_rows], "ids": [len(ids)]}
            )
            shard += 1

    files = dealt.mapInArrow(task(run), "part int, shard int, path string, docs bigint, ids bigint")
    return Stages(spark, "shards").keep(files, "files")


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SHARD_BYTES of text, small ones joined."""
    held, size = [], 0
    for whole in batches:
        for batch in text_slices(whole, "text", SHARD_BYTES):
            mine = len(text_bytes(batch.column(1))[0])
            if held and size + mine > SHARD_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(batch)
            size += mine
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def read_shards(files: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Decode listed shard files: the id, `start` (ids of all documents before it), `n_tokens` and `ids`
    (binary, little-endian unsigned 32-bit numbers) of each document."""
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(*earlier)
    # One row per part of the range partitioning.
    parts = files.groupBy("part").agg(F.sum("ids").alias("part_ids"))
    parts = parts.withColumn("before", F.coalesce(F.sum("part_ids").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)))
    placed = files.join(parts.drop("part_ids"), "part").withColumn("base", F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(path)
                ids = shard.ids()
                if len(ids) != shard.n:
                    raise ValueError(f"{path}: {len(ids)} ids, {shard.n} are stated")
                yield pa.RecordBatch.from_arrays(
                    [
                        shard.doc_ids,
                        pa.array(shard.borders[:-1] + base),
                        pa.array(np.diff(shard.borders)),
                        strings(ids.astype("<u4").view(np.uint8), shard.borders * 4, pa.binary()),
                    ],
                    names=[doc_id, "start", "n_tokens", "ids"],
                )

    spread = placed.select("path", "base").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(task(run), f"`{doc_id}` bigint, start bigint, n_tokens bigint, ids binary")
