"""SimHash near-duplicates: every pair of fingerprints compared, in tiles.

Distinct fingerprints are sorted by population count and cut into blocks. A pair of blocks meets in one
task if their population counts can lie within the radius of each other. There the blocks are cut into
tiles by the population counts of the fingerprint's four quarters; two fingerprints differ in at least
as many bits as these counts do, so far tile pairs are skipped, and the others are compared with numpy
exclusive-or and bit counts. A task hands on a spanning star per local group, not its pairs, and stars
are joined to components by alternating large and small stars over staged tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import (
    LOWER,
    NOT_SPACE,
    Stages,
    folder_for,
    partitions_for,
    per_process,
    read_file,
    task,
    text_bytes,
    text_slices,
    unused,
    word_spans,
    write_file,
)

SLICE_BYTES = 1 << 19
BLOCK_ROWS = 32_768
TILE_ROWS = 256
SEED = 42

# ---- fingerprints --------------------------------------------------------------------------------


def fingerprints(text: pa.Array, shingle: int) -> np.ndarray:
    """A 64-bit fingerprint per text: the majority of each bit over the hashes of its word shingles."""
    data, borders = text_bytes(text)
    data = LOWER[data]
    starts, ends, row = word_spans(data, borders, NOT_SPACE)
    # Words laid out with one space between them, so that a shingle is a slice.
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    new_starts = new_ends - sizes
    laid = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, 0x20, np.uint8)
    laid[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[NOT_SPACE[data]]
    words = np.diff(row)
    count = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
    doc = np.repeat(np.arange(len(words)), count)
    begin = np.zeros(len(words) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    first = np.arange(begin[-1]) - begin[doc] + row[doc]
    last = np.minimum(first + shingle, row[doc + 1]) - 1
    buffer, digest = laid.tobytes(), xxhash.xxh64_intdigest
    h = np.array(
        [digest(buffer[a:b], SEED) for a, b in zip(new_starts[first].tolist(), new_ends[last].tolist())], np.uint64
    )
    out = np.zeros(len(words), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int64)
        most = ones * 2 > count[full, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def add_fingerprint(docs: DataFrame, text: str, shingle: int, name: str) -> DataFrame:
    """`docs` with a bigint column that holds the fingerprint's bits."""
    kept = docs.drop(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text, SLICE_BYTES):
                f = fingerprints(batch.column(batch.schema.get_field_index(text)), shingle)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f.view(np.int64))], names=[*batch.schema.names, name])

    return kept.mapInArrow(task(run), f"{schema}, `{name}` bigint")


# ---- tiles ---------------------------------------------------------------------------------------


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Tiles:
    """Fingerprints sorted by the population counts of their quarters, in runs with their count ranges."""

    def __init__(self, x: np.ndarray):
        q = _quarters(x)
        order = np.lexsort(q.T[::-1])
        self.x, q = x[order], q[order]
        self.cuts = np.arange(0, len(x), TILE_ROWS)
        self.low = np.minimum.reduceat(q, self.cuts, axis=0)
        self.high = np.maximum.reduceat(q, self.cuts, axis=0)

        self.upper = (self.x >> np.uint64(32)).astype(np.uint32)

    def rows(self, t: int) -> slice:
        return slice(self.cuts[t], self.cuts[t] + TILE_ROWS)


class Groups:
    """Components of numbered nodes, as edges come in."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            parent = np.arange(len(label))
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := parent[parent], parent):
                parent = jumped
            label[:] = parent[label]


def star_edges(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, its group's first) for all in groups linked within `a`, or between `a` and `b`."""
    left = Tiles(a)
    right = left if b is None else Tiles(b)
    base = 0 if b is None else len(a)
    nodes = left.x if b is None else np.concatenate([left.x, right.x])
    groups = Groups(len(nodes))
    buffers = np.empty(TILE_ROWS * TILE_ROWS, np.uint32), np.empty(TILE_ROWS * TILE_ROWS, np.uint8)
    for t in range(len(left.cuts)):
        gap = np.maximum(0, np.maximum(right.low - left.high[t], left.low[t] - right.high)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if b is None:
            near = near[near >= t]
        mine = left.upper[left.rows(t), None]
        for r in near:
            theirs = right.upper[None, right.rows(r)]
            shape = (len(mine), theirs.shape[1])
            x, ones = (b[: shape[0] * shape[1]].reshape(shape) for b in buffers)
            np.bitwise_xor(mine, theirs, out=x)
            np.bitwise_count(x, out=ones)
            at = np.flatnonzero(ones <= radius)
            if len(at):
                # The upper halves are near: the whole fingerprints decide.
                i, j = at // shape[1] + left.cuts[t], at % shape[1] + right.cuts[r]
                link = np.bitwise_count(left.x[i] ^ right.x[j]) <= radius
                i, j = i[link], j[link] + base
                if not (i == j).all():
                    groups.add(i, j)
    linked = np.flatnonzero(groups.label != np.arange(len(nodes)))
    return nodes[linked], nodes[groups.label[linked]]


# ---- components ----------------------------------------------------------------------------------


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """Rows (u, root) for every node of `edges` (bigints u, v) but the roots, the least of each component.

    Large stars, then small stars, until nothing changes. A node's minimum is found by a pre-aggregated
    grouping and joined back, so a node with very many links is no single task's burden.
    """
    c = F.col

    def least(links: DataFrame) -> DataFrame:
        return links.groupBy("u").agg(F.min("v").alias("m")).select(c("u").alias("w"), F.least("w", "m").alias("m"))

    def state(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = stages.keep(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(c("v").alias("u"), c("u").alias("v")))
        large = both.join(least(both), c("u") == c("w")).where(c("v") > c("u")).select(c("v").alias("u"), c("m").alias("v"))
        large = stages.keep(large.where(c("u") != c("v")).distinct(), "large")
        small = large.join(least(large), c("u") == c("w"))
        small = small.select(c("v").alias("u"), c("m").alias("v")).unionByName(small.select("u", c("m").alias("v")))
        then = stages.keep(small.where(c("u") != c("v")).distinct(), "small")
        stages.drop(now, large)
        now, after = then, state(then)
        if after == before:
            break
        before = after
    return now.select("u", c("v").alias("root"))


# ---- the operator --------------------------------------------------------------------------------


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """A row per row of `docs`: the id, `fingerprint` (bigint), `component_id` (the least id reachable over
    links of at most `radius` differing bits, itself included), and `keep_id`, `keep_fingerprint`: the
    row that stands for the component, the one of least id, then of least fingerprint.

    A-Z count as a-z; words are runs without ASCII white space; repeated shingles count each time; a text
    of fewer words is one shingle. Null, empty and blank texts have fingerprint 0 and are linked by it like
    any other. A null id is never the least unless all of a component are null. Rows that share an id are
    rows of their own. Other columns of `docs` are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    c = F.col
    stages = Stages(spark, "simhash")
    ids = docs.select(c(doc_id).alias("id"), c(text).alias("text"))
    marked = stages.keep(add_fingerprint(ids, "text", shingle, "fingerprint").drop("text"), "fingerprints")
    distinct = stages.keep(marked.groupBy(c("fingerprint").alias("f")).agg(F.min("id").alias("least")), "distinct")
    n = distinct.count()
    blocks = stages.keep(_blocks(distinct, max(12, -(-n // BLOCK_ROWS))), "blocks")
    edges = stages.keep(_edges(blocks, radius), "stars")
    roots = components(edges, stages)
    # The least (id, fingerprint) of each component, found among one row per fingerprint.
    rooted = distinct.join(roots.withColumnRenamed("u", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    first = F.min(F.struct(c("least").isNull().alias("none"), "least", "f"))
    heads = rooted.groupBy("root").agg(first.alias("head"))
    classes = rooted.join(heads, "root").select(
        c("f").alias("fingerprint"), c("head.least").alias("keep_id"), c("head.f").alias("keep_fingerprint")
    )
    classes = stages.keep(classes, "classes")
    return marked.join(classes, "fingerprint").select(
        c("id").alias(doc_id), "fingerprint", c("keep_id").alias("component_id"), "keep_id", "keep_fingerprint"
    )


def _blocks(distinct: DataFrame, count: int) -> DataFrame:
    """Rows (block, low, high, path): runs of fingerprints in order of population count, each in a file."""
    ones, folder = F.bit_count("f"), folder_for(distinct.sparkSession, "fingerprint-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy() for b in batches]
        x = np.concatenate(held) if held else np.zeros(0, np.int64)
        for at in range(0, len(x), BLOCK_ROWS):
            part = x[at : at + BLOCK_ROWS]
            pops = np.bitwise_count(part.view(np.uint64))
            path = f"{folder}/{uuid.uuid4().hex}.bin"
            write_file(path, part.tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([int(part[0])], pa.int64()),
                    "low": pa.array([int(pops.min())], pa.int32()),
                    "high": pa.array([int(pops.max())], pa.int32()),
                    "path": pa.array([path], pa.string()),
                }
            )

    dealt = distinct.select("f").repartitionByRange(count, ones, "f").sortWithinPartitions(ones, "f")
    return dealt.mapInArrow(task(run), "block bigint, low int, high int, path string")


def _edges(blocks: DataFrame, radius: int) -> DataFrame:
    """Stars (u, v) over all pairs of blocks whose population counts can lie within the radius."""
    c = F.col
    spans = blocks.select("block", "low", "high")
    reach = spans.select(c("block").alias("i"), F.explode(F.sequence("low", c("high") + radius)).alias("ones"))
    held = spans.select(c("block").alias("j"), F.explode(F.sequence("low", "high")).alias("ones"))
    # A pair is found from the block whose counts begin no higher, or from both; each is kept once.
    pairs = reach.join(held, "ones").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    # Tasks get names alone and read the blocks; pairs of one block follow each other, which stays in hand.
    paths = blocks.select("block", "path")
    both = pairs.join(paths.select(c("block").alias("i"), c("path").alias("a")), "i")
    both = both.join(paths.select(c("block").alias("j"), c("path").alias("b")), "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(batch.column(k).to_pylist() for k in ("a", "b"))):
                first = per_process("fingerprint block", a, lambda: np.frombuffer(read_file(a), np.uint64))  # noqa: B023
                u, v = star_edges(first, None if a == b else np.frombuffer(read_file(b), np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    parts = partitions_for(blocks.sparkSession, 0, 1)
    spread = both.select("i", "j", "a", "b").repartitionByRange(parts, "i", "j").sortWithinPartitions("i", "j")
    return spread.mapInArrow(task(run), "u bigint, v bigint")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `docs` that stand for their component, one of each, with all columns of `docs`.

    The text is shuffled once, by id and fingerprint; rows that agree in both are copies of each other.
    """
    mark, key = unused(docs, "_fingerprint"), unused(docs, "_key")

    def key_of(number: str, bits: str):
        return F.concat_ws(":", F.coalesce(F.col(number).cast("string"), F.lit("null")), F.col(bits).cast("string"))

    heads = near_groups(docs, doc_id, text, shingle, radius).select(key_of("keep_id", "keep_fingerprint").alias(key)).distinct()
    marked = add_fingerprint(docs, text, shingle, mark).withColumn(key, key_of(doc_id, mark)).drop(mark)
    return marked.join(heads, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
