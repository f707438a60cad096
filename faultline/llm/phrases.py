"""Phrases whose words occur together: counts of phrases by their words, from short ones to long ones.

A first pass counts every word and every pair. Phrases of three words and more need no count of all: only phrases of
`least` occurrences matter, and these consist of pairs and triples that have as many. So a second pass counts the
triples of two frequent pairs, a third one the phrases of four and five words that consist of frequent triples. Each
phrase is counted once, in the pass of its size; the total of a language comes with its words.

A bit filter of fixed size, of hashes, holds the frequent pairs, then the triples. It lets a rare one through at worst,
which costs a row and changes no result: what is counted is judged exactly. Where frequent ones outgrow the
filter it spares less, down to every phrase being counted.

A task sums equal phrases of a slice of text, so a pass gives out no more rows than there are words, and one per
language and slice. What the second and third pass count grows towards that: with `least` as it is, more phrases
are frequent in a larger table.

Text is lower-cased from A to Z alone, split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into
words. Edge cases: null and empty texts have no words, a null language is `und`; repeated rows count as often as they
occur; a text of any length is counted as a whole, slices are of whole rows; an empty table has no phrases. Columns
other than text and language are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from faultline.llm.common import LOWER, Stages, mix, per_process, span_hashes, strings, task, text_bytes, text_slices, word_spans

#: No word is empty, so an empty phrase stands for all words.
ALL = ""
SLICE_BYTES = 1 << 21
#: Phrases that a task gives out at once.
ROWS_EACH = 1 << 15
#: Bits of the filter at most: 16 MB in every worker.
FILTER_BITS = 1 << 27
_PAGE_BITS = 1 << 15

_BYTES = np.arange(256)
_SEPARATES = np.isin(_BYTES, [*b".,;:!?", *range(0x0A, 0x0E)])
_IS_WORD = ~_SEPARATES & ~np.isin(_BYTES, [0x20, 0x09])
_RADIX = np.uint64(0xD6E8FEB86659FD93)


# ---- words of a slice ----------------------------------------------------------------------------


class _Words:
    """The words of some rows: their spans, hashes that differ by language, and which follow the one before."""

    def __init__(self, rows: pa.RecordBatch):
        raw, borders = text_bytes(rows.column(0))
        self.data = LOWER[raw]
        self.starts, self.ends, self.firsts = word_spans(self.data, borders, _IS_WORD)
        firsts = self.firsts
        langs = rows.column(1).dictionary_encode()
        self.langs = langs.dictionary
        self.lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(firsts))
        hashes = span_hashes(*_spans(self.langs))
        self.hashes = mix(span_hashes(self.data, self.starts, self.ends) + hashes[self.lang] * _RADIX)
        # A word leads to the next one if no separator and no row's end lies between.
        passed = np.cumsum(_SEPARATES[self.data])
        self.leads = np.zeros(len(self.starts), bool)
        self.leads[:-1] = passed[self.starts[1:]] == passed[self.starts[:-1]]
        self.leads[firsts[1:][firsts[1:] > 0] - 1] = False

        #: Hash of each word with the next, whether it leads to it or not.
        self.pair_hashes = mix(self.hashes * _RADIX + np.append(self.hashes[1:], np.uint64(0)))

    def passing(self, bits: np.ndarray) -> np.ndarray:
        """Which words lead to the next one by a pair that the filter holds."""
        out = self.leads.copy()
        out[out] = _passes(bits, self.pair_hashes[out])
        return out

    def triples(self, bits: np.ndarray) -> np.ndarray:
        """Which words lead to the next two by a triple that the filter holds."""
        out = self.leads.copy()
        out[:-1] &= self.leads[1:]
        at = np.flatnonzero(out)
        out[at] = _passes(bits, self.triple_hashes(at))
        return out

    def triple_hashes(self, at: np.ndarray) -> np.ndarray:
        """Hash of each word of `at` with the next two."""
        return mix(self.pair_hashes[at] * _RADIX + self.hashes[at + 2])

    @cached_property
    def _spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words, each with a space behind it, and where they begin."""
        borders = np.concatenate([[0], np.cumsum(self.ends - self.starts + 1)])
        out = np.full(borders[-1], 0x20, np.uint8)
        of_word = np.ones(len(out), bool)
        of_word[borders[1:] - 1] = False
        out[of_word] = self.data[_IS_WORD[self.data]]
        return out, borders

    def texts(self, at: np.ndarray, size: int) -> pa.Array:
        """The phrases of `size` words that begin at `at`, joined by one space."""
        data, borders = self._spaced
        starts = borders[at]
        sizes = borders[at + size] - 1 - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return strings(data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)], ends)

    def counted(self, at: np.ndarray, size: int, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of the phrases of `size` words that begin at `at` and have these hashes."""
        _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        for k in range(0, len(first), ROWS_EACH):
            shown = at[first[k : k + ROWS_EACH]]
            yield pa.record_batch(
                {
                    "lang": pc.take(self.langs, pa.array(self.lang[shown])),
                    "phrase": self.texts(shown, size),
                    "n": counts[k : k + ROWS_EACH].astype(np.int64),
                }
            )


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, borders = text_bytes(texts)
    return data, borders[:-1], borders[1:]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    for batch in batches:
        for rows in text_slices(batch, batch.schema.names[0], SLICE_BYTES):
            words = _Words(rows)
            if len(words.starts):
                yield words


PHRASE_COUNTS = "lang string, phrase string, n bigint"


@task
def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the words and of the pairs of every slice, and of all its words."""
    for words in _slices(batches):
        totals = np.bincount(words.lang, minlength=len(words.langs)).astype(np.int64)
        yield pa.record_batch({"lang": words.langs, "phrase": [ALL] * len(totals), "n": totals})
        yield from words.counted(np.arange(len(words.starts)), 1, words.hashes)
        at = np.flatnonzero(words.leads)
        yield from words.counted(at, 2, words.pair_hashes[at])


def _triples(words: _Words, bits: np.ndarray) -> np.ndarray:
    """The words that begin a triple of two pairs in the filter."""
    pairs = words.passing(bits)
    return np.flatnonzero(pairs[:-1] & pairs[1:])


# ---- the filter ----------------------------------------------------------------------------------


def _filter_pages(frequent: DataFrame, bits: int) -> DataFrame:
    """(page, mask): the set bits of the filter, two to a hash, in pages of 4 KB; at most bits / 8 bytes."""
    low, high = F.col("hash"), F.shiftrightunsigned("hash", 32)
    bit = F.explode(F.array(*(h.bitwiseAND(F.lit(bits - 1)) for h in (low, high))))
    return (
        frequent.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / _PAGE_BITS).cast("int").alias("page"))
        .agg(F.collect_set((F.col("bit") % _PAGE_BITS).cast("int")).alias("set"))
        .mapInArrow(_pack, "page int, mask binary")
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = []
        for row in batch.column("set"):
            page = np.zeros(_PAGE_BITS, bool)
            page[row.values.to_numpy()] = True
            masks.append(np.packbits(page, bitorder="little").tobytes())
        yield pa.record_batch({"page": batch.column("page"), "mask": pa.array(masks, pa.binary())})


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter holds each hash; always, if it was put in."""
    out = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.uint64(32)):
        bit = h & np.uint64(len(bits) * 8 - 1)
        out &= (bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class _Filter:
    """The filter on its way to the workers: pages of bits, of one or more sets of hashes."""

    def __init__(self, spark: SparkSession, pages: list[tuple[int, bytes]], bits: int):
        self.name, self.bits, self.pages = uuid.uuid4().hex, bits, pages
        self.shared = spark.sparkContext.broadcast(pages)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pages"}

    def held(self) -> np.ndarray:
        """The filter's bits in a task."""
        return per_process("phrase filter", self.name, self._unpacked)

    def _unpacked(self) -> np.ndarray:
        out = np.zeros(self.bits // 8, np.uint8)
        for page, mask in self.shared.value:
            out[page * _PAGE_BITS // 8 : (page + 1) * _PAGE_BITS // 8] |= np.frombuffer(mask, np.uint8)
        return out


def _filter(frequent: DataFrame, size: int, bits: int) -> _Filter:
    """Of the phrases of `size` words, 2 or 3, of (lang, phrase) rows."""

    @task
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            at = words.firsts[:-1]
            yield pa.record_batch({"hash": (words.pair_hashes[at] if size == 2 else words.triple_hashes(at)).view(np.int64)})

    of_size = frequent.where(_size(F.col("phrase")) == size).select("phrase", "lang")
    pages = _filter_pages(of_size.mapInArrow(hashed, "hash bigint"), bits).collect()
    return _Filter(frequent.sparkSession, [(r.page, bytes(r.mask)) for r in pages], bits)


# ---- counts --------------------------------------------------------------------------------------


def _size(phrase: Column) -> Column:
    return F.when(phrase == ALL, 0).otherwise(F.size(F.split(phrase, " ")))


def frequent_phrases(texts: DataFrame, least: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, words, size, f): the phrases of up to five words that occur `least` times; of size 0, of all words.

    `texts` has text and language alone.
    """
    stages = Stages(texts.sparkSession, "phrases")

    def frequent(count, name: str) -> DataFrame:
        summed = texts.mapInArrow(count, PHRASE_COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        return stages.keep(summed.where((F.col("phrase") == ALL) | (F.col("f") >= least)), name)

    short = frequent(_count_pairs, "pairs")
    pairs = _filter(short, 2, filter_bits)

    @task
    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            at = _triples(words, pairs.held())
            yield from words.counted(at, 3, words.triple_hashes(at))

    middle = frequent(count_triples, "triples")
    triples = _filter(middle, 3, filter_bits)

    @task
    def count_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _slices(batches):
            held = words.triples(triples.held())
            at = np.flatnonzero(held[:-1] & held[1:])
            hashes = mix(words.triple_hashes(at) * _RADIX + words.hashes[at + 3])
            yield from words.counted(at, 4, hashes)
            # No triple begins at the last two words, so a longer phrase stays inside.
            on = held[np.minimum(at + 2, len(held) - 1)]
            at = at[on]
            yield from words.counted(at, 5, mix(hashes[on] * _RADIX + words.hashes[at + 4]))

    found = short.unionByName(middle).unionByName(frequent(count_long, "long"))
    words = F.when(F.col("phrase") == ALL, F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
    return found.select("lang", words.alias("words"), _size(F.col("phrase")).alias("size"), "f")


def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(
    docs: DataFrame,
    least: int = 100,
    top: int | None = 2000,
    absorb: int = 100,
    text: str = "text",
    lang: str = "lang",
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the documents, as `ranked` defines them."""
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return ranked(frequent_phrases(texts, least, filter_bits), least, top, absorb)


def ranked(counts: DataFrame, least: int = 100, top: int | None = 2000, absorb: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of two to five words, best first in each language.

    A phrase occurs `a` >= `least` times; of its cuts into two parts, occurring `l` and `r` times, the one of
    least score floor(1000 * a * n / (l * r)) counts, the earliest of equals. Phrases inside a longer
    one that occurs `absorb` percent as often are left out. `top` keeps the first of each language, None all.
    """
    kept = counts.where((F.col("size") == 0) | (F.col("f") >= least))
    totals = kept.where(F.col("size") == 0).select("lang", F.col("f").alias("n"))
    phrases = kept.where(F.col("size") > 0)
    parts = phrases.select("lang", _phrase(F.col("words")).alias("part"), F.col("f").alias("part_f"))
    candidates = phrases.where(F.col("size") >= 2).select(
        "lang", "words", "size", _phrase(F.col("words")).alias("phrase"), F.col("f").alias("a")
    )

    def counted(cuts: DataFrame, part: str, f: str) -> DataFrame:
        return cuts.join(parts.withColumnsRenamed({"part": part, "part_f": f}), ["lang", part])

    cuts = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("first", _phrase(F.slice("words", F.lit(1), F.col("k"))))
        .withColumn("rest", _phrase(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k"))))
        .select("lang", "phrase", "a", "k", "first", "rest")
    )
    cuts = counted(counted(cuts, "first", "l"), "rest", "r").join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    # 1000 a n passes 64 bits but not 38 digits; l and r are at least a, so the score fits a long.
    cuts = cuts.withColumns({f"_{c}": v for c, v in wide.items()}).withColumn(
        "score", F.expr("(cast(1000 as decimal(4,0)) * _a * _n) div (_l * _r)")
    )
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("least")
    )
    inside = (
        candidates.where(F.col("size") >= 3)
        .withColumn("width", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
        .withColumn("from", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("width") + 1)))
        .groupBy("lang", _phrase(F.slice("words", F.col("from"), F.col("width"))).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    left = (
        scored.join(inside, ["lang", "phrase"], "left")
        .select("lang", "phrase", "least.*", "longer")
        .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * absorb))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    placed = left.withColumn("rank", F.row_number().over(best).cast("bigint"))
    if top is not None:
        placed = placed.where(F.col("rank") <= top)
    return placed.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
