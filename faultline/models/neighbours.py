"""Exact nearest neighbours in Euclidean distance, and votes over them.

Equal training vectors are merged into one with a count and written once, as files of one group each, to the folder
that all tasks share. Queries are dealt into blocks by hash; a task reads its group's files block of points by block of
points, sized by what a worker holds, and carries each query's best from one to the next. So nothing is copied per
block but bytes read, and a query's answer leaves its task as one row of its `k` best, which votes read as it is.
Neighbours are ordered by (distance, label).

Within a block the points lie in small cells of a k-d tree over their main axes. A query's nearest
cells give it a bound; cells whose box lies farther are left out, and of the points in the others a short
product in single precision, lowered by its rounding, leaves few whose distance has to be taken. No point
within the bound is lost, so the answer is that of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from faultline.session import new_folder, open_shared, release, stage

#: Rows of a block of points and of queries: with 30 features a task takes some 600 MB for them.
POINT_ROWS = 125_000
QUERY_ROWS = 150_000
#: Blocks of queries that a core takes one after the other, at least.
TURNS = 3
#: Columns that number the groups, and the blocks of queries within one.
CELL_OF, PART_OF = "search_cell", "search_part"
SLICE = 2_000_000
#: Points of a cell, main axes that are looked at first, queries at once, and cells that give the first bound.
CELL = 256
AXES = 16
ASKED = 4096
FIRST = 8
#: Distances taken at once, and neighbours held before all but the k best are dropped.
EXACT = 50_000
HELD = 500_000

_BEST = [
    T.StructField("d", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.ArrayType(T.IntegerType())),
    T.StructField("copies", T.ArrayType(T.LongType())),
]


def _slices(rows: int, width: int):
    step = max(1, SLICE // max(width, 1))
    return (slice(at, at + step) for at in range(0, rows, step))


#: (query, distance, label, copies) of neighbours found, by query and from the nearest on.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _best(x: np.ndarray, points: np.ndarray, label: np.ndarray, copies: np.ndarray, k: int):
    """Per query: distances, labels and copies of the nearest points, until k copies are met."""
    return _by_query(len(x), _found(x, points, label, copies, k))


def _best_of_cells(x: np.ndarray, points: np.ndarray, label: np.ndarray, copies: np.ndarray, k: int):
    return _by_query(len(x), _found_in_cells(x, points, label, copies, k, np.full(len(x), np.inf)))


def _best_of_all(x: np.ndarray, points: np.ndarray, label: np.ndarray, copies: np.ndarray, k: int):
    return _by_query(len(x), _found_in_all(x, points, label, copies, k))


def _by_query(n: int, found: Found) -> list[tuple]:
    edges = np.searchsorted(found[0], np.arange(n + 1)).tolist()
    return [tuple(column[a:b] for column in found[1:]) for a, b in zip(edges[:-1], edges[1:])]


def _found(x, points, label, copies, k: int, bound: np.ndarray | None = None) -> Found:
    """The nearest of each query until k copies are met, of those within its bound if one is given; more may come along."""
    if len(points) <= 4 * CELL or k > CELL or not (_tame(x) and _tame(points)):
        return _found_in_all(x, points, label, copies, k)
    return _found_in_cells(x, points, label, copies, k, np.full(len(x), np.inf) if bound is None else bound)


def _nearest_of(x: np.ndarray, blocks: Iterator[tuple], k: int) -> Found:
    """The nearest of each query among all blocks of points, until k copies are met."""
    best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)
    bound = np.full(len(x), np.inf)
    for points, label, copies in blocks:
        more = _found(x, points, label, copies, k, bound)
        del points  # before the next block is read
        row, distance, label, copies = (np.concatenate(c) for c in zip(best, more))
        order = np.lexsort((copies, label, distance, row))
        row, distance, label, copies = row[order], distance[order], label[order], copies[order]
        edges = np.searchsorted(row, np.arange(len(x) + 1))
        after = np.cumsum(copies)
        before = after - copies
        own = before - before[edges[row]]
        kept = own < k
        # Where k copies are met, the last one kept bounds what other blocks can add.
        last = kept & (own + copies >= k)
        bound[row[last]] = distance[last]
        best = row[kept], distance[kept], label[kept], copies[kept]
    return best


def _tame(rows: np.ndarray) -> bool:
    """Whether squares of the values stay well inside single precision."""
    return bool((np.abs(rows) < 1e15).all())


def _cells(x: np.ndarray) -> list[np.ndarray]:
    """The rows in cells of at most `CELL`, by halving the widest axis at its median."""
    levels = int(np.ceil(np.log2(len(x) / CELL)))
    # Cells of one size; what is missing to that are repeated rows, left out again at the end.
    order = np.arange(-(-len(x) // (1 << levels)) << levels)
    for level in range(levels):
        order = order.reshape(1 << level, -1)
        inside = x[order % len(x)]
        widest = inside.var(axis=1).argmax(axis=1)
        value = np.take_along_axis(inside, widest[:, None, None], 2)[:, :, 0]
        order = np.take_along_axis(order, np.argpartition(value, order.shape[1] // 2, axis=1), 1)
    cells = (rows[rows < len(x)] for rows in order.reshape(1 << levels, -1))
    return [rows for rows in cells if len(rows)]


def _asking(y: np.ndarray, slack: float) -> np.ndarray:
    """Rows whose products with those of `_answering` are squared distances, less `slack` of both squares."""
    return np.hstack([-2 * y, (1 - slack) * (y * y).sum(axis=1)[:, None], np.ones((len(y), 1))])


def _answering(y: np.ndarray, slack: float) -> np.ndarray:
    return np.hstack([y, np.ones((len(y), 1)), (1 - slack) * (y * y).sum(axis=1)[:, None]]).astype(np.float32)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    gap = x - points
    return np.sqrt((gap * gap).sum(axis=-1))


class _Nearest:
    """Neighbours found for some queries: (row, point, distance), of which the best are kept."""

    def __init__(self, x: np.ndarray, points: np.ndarray, label: np.ndarray, copies: np.ndarray, k: int, place: np.ndarray):
        self.x, self.points, self.label, self.copies, self.k, self.place = x, points, label, copies, k, place
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.found: list[tuple] = []
        self.held = 0

    def add(self, row: np.ndarray, at: np.ndarray, bound: np.ndarray) -> None:
        for a in range(0, len(row), EXACT):
            r, p = row[a : a + EXACT], at[a : a + EXACT]
            distance = _distances(self.x[r], self.points[p])
            near = distance <= bound[r]
            self.found.append((r[near], p[near], distance[near]))
            self.held += int(near.sum())
        if self.held > HELD:
            self.settle()

    def settle(self) -> np.ndarray:
        """Keep each query's nearest until k copies are met; the edges of the queries' runs in `kept`."""
        row, at, distance = (np.concatenate(c) for c in zip(self.kept, *self.found))
        order = np.lexsort((self.place[at], self.label[at], distance, row))
        row, at, distance = row[order], at[order], distance[order]
        edges = np.searchsorted(row, np.arange(len(self.x) + 1))
        before = np.append(0, np.cumsum(self.copies[at]))
        wanted = before[:-1] - before[edges[row]] < self.k
        self.kept, self.found, self.held = (row[wanted], at[wanted], distance[wanted]), [], 0
        return np.searchsorted(self.kept[0], np.arange(len(self.x) + 1))


def _found_in_cells(x, points, label, copies, k: int, most: np.ndarray) -> Found:
    """The nearest of each query within `most`."""
    middle = points.mean(axis=0)
    turned = points - middle
    axes = np.linalg.eigh(turned.T @ turned)[1][:, ::-1]
    turned = turned @ axes

    def short(y: np.ndarray) -> np.ndarray:
        """The main axes, and the length of the rest: no two rows are farther apart here than they are."""
        return np.hstack([y[:, :AXES], np.sqrt((y[:, AXES:] ** 2).sum(axis=1))[:, None]])

    own = short(turned)
    cells = _cells(own.astype(np.float32))
    order, edge = np.concatenate(cells), np.append(0, np.cumsum([len(c) for c in cells]))
    points, label, copies, own, turned = points[order], label[order], copies[order], own[order], turned[order]
    low = np.minimum.reduceat(own, edge[:-1]).astype(np.float32)
    high = np.maximum.reduceat(own, edge[:-1]).astype(np.float32)
    # Rounding in single precision: of each value, and of every step of a product.
    slack = 4 * (x.shape[1] + 8) * 2.0**-24
    whole, brief = _answering(turned, slack), _answering(own, slack)
    del turned, own
    spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
    # Boxes may be off by the rounding of their sides.
    reach = 1e-6 * max(1.0, float(np.abs(low).max()), float(np.abs(high).max()))
    widest = max(stop - start for start, stop in spans)
    held = np.empty(ASKED * widest, np.float32), np.zeros(ASKED * widest + 8, bool)
    out = []
    for a in range(0, len(x), ASKED):
        query = x[a : a + ASKED]
        asked = (query - middle) @ axes
        hint = short(asked)
        away = np.zeros((len(cells), len(query)), np.float32)
        for j in range(hint.shape[1]):
            c = hint[:, j].astype(np.float32)
            room = np.float32(reach + 1e-6 * np.abs(c).max())
            gap = np.maximum(low[:, j, None] - c, c - high[:, j, None]) - room
            np.maximum(gap, 0, out=gap)
            away += np.square(gap, out=gap)
        bound = most[a : a + ASKED].copy()
        if not np.isfinite(bound).all():
            first = _first_bound(query, _asking(asked, slack).astype(np.float32), whole, points, away, spans, k)
            np.minimum(bound, first, out=bound)
        near = _Nearest(query, points, label, copies, k, order)
        line = _asking(hint, slack)
        done = np.zeros(away.shape, bool)
        for share in (0.5, 1.0):
            # Squares of distances up to the bound, with room for the roots taken.
            limit = bound * bound * (1 + 1e-5)
            wanted = (away <= (share * limit * (1 + 1e-5)).astype(np.float32)) & ~done
            done |= wanted
            bent = line.copy()
            bent[:, -2] -= limit
            bent = bent.astype(np.float32)
            rows_, at_, size = [], [], 0
            for (start, stop), some in zip(spans, wanted):
                row = np.flatnonzero(some)
                if not len(row):
                    continue
                hit = _at_most_zero(bent[row], brief[start:stop].T, held)
                if len(hit):
                    i, j = np.divmod(hit, stop - start)
                    rows_.append(row[i])
                    at_.append(j + start)
                    size += len(hit)
                if size > EXACT:
                    near.add(np.concatenate(rows_), np.concatenate(at_), bound)
                    rows_, at_, size = [], [], 0
            if size:
                near.add(np.concatenate(rows_), np.concatenate(at_), bound)
            edges = near.settle()
            row, at, distance = near.kept
            # The last one kept bounds the search if k copies are met.
            total = np.append(0, np.cumsum(copies[at]))
            full = np.flatnonzero(total[edges[1:]] - total[edges[:-1]] >= k)
            bound[full] = np.minimum(bound[full], distance[edges[full + 1] - 1])
        out.append((row + a, distance, label[at], copies[at]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _at_most_zero(rows: np.ndarray, columns: np.ndarray, room: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places in `rows @ columns`, laid end to end, of what is not above zero. They are few: eight are looked at as one word."""
    size = len(rows) * columns.shape[1]
    product, low = room[0][:size].reshape(len(rows), -1), room[1]
    np.matmul(rows, columns, out=product)
    np.less_equal(product, 0, out=low[:size].reshape(product.shape))
    whole = -(-size // 8) * 8
    low[size:whole] = False
    some = np.flatnonzero(low[:whole].view(np.uint64))
    return (some[:, None] * 8 + np.arange(8))[low[:whole].reshape(-1, 8)[some]]


def _first_bound(query, line, whole, points, away, spans, k: int) -> np.ndarray:
    """The distance of the k-th nearest point in each query's nearest cells."""
    first = min(FIRST + k // CELL, len(spans))
    cell = np.argpartition(away, first - 1, axis=0)[:first].ravel()
    row = np.tile(np.arange(len(query)), first)
    order = np.argsort(cell, kind="stable")
    cell, row = cell[order], row[order]
    best = np.full((len(query), k), np.inf)
    for mine in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
        (start, stop), asking = spans[cell[mine[0]]], row[mine]
        rough = line[asking] @ whole[start:stop].T
        few = min(k, stop - start)
        at = rough.argmin(axis=1)[:, None] if few == 1 else np.argpartition(rough, few - 1, axis=1)[:, :few]
        found = _distances(query[asking][:, None, :], points[start + at])
        best[asking] = np.partition(np.hstack([best[asking], found]), k - 1, axis=1)[:, :k]
    return best[:, -1] if k == 1 else best.max(axis=1)


def _found_in_all(x, points, label, copies, k: int) -> Found:
    """A matrix product finds all points that could be among the k nearest, with room for its
    rounding; only for those are distances taken exactly.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0), label[:0], copies[:0])]
    weight = (points * points).sum(axis=1)
    for part in _slices(len(x), len(points)):
        query = x[part]
        own = (query * query).sum(axis=1)
        rough = weight[None, :] - 2 * (query @ points.T)
        if len(points) > k:
            room = 1e-9 * (own + weight.max())
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + room
        else:
            limit = np.full(len(query), np.inf)
        row, at = np.nonzero(rough <= limit[:, None])
        gap = query[row] - points[at]
        distance = np.sqrt((gap * gap).sum(axis=1))
        order = np.lexsort((label[at], distance, row))
        row, at, distance = row[order], at[order], distance[order]
        edges = np.searchsorted(row, np.arange(len(query) + 1))
        before = np.append(0, np.cumsum(copies[at]))
        near = before[:-1] - before[edges[row]] < k
        out.append((row[near] + part.start, distance[near], label[at[near]], copies[at[near]]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _merge_copies(train: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    label = F.col("label").cast("int").alias("label")
    return train.groupBy(*by, label, *features).agg(F.count(F.lit(1)).alias("copies"))


def neighbours(
    train: DataFrame,
    queries: DataFrame,
    features: list[str],
    keys: list[str],
    k: int,
    by: list[str] = ["round", "fold"],
    point_rows: int = POINT_ROWS,
    query_rows: int = QUERY_ROWS,
    max_train_rows: int | None = None,
) -> DataFrame:
    """(by, keys, y, d, label, copies): up to k rows per query, `copies` of equal points each.

    `train` and `queries` share the `by` columns, whose combinations must be few. Work is points times
    queries, as an exact search in many dimensions must be; `max_train_rows`, off by default, bounds it
    by a hash sample of about so many distinct points per group. A group without points answers nothing.
    """
    found = nearest(train, queries, features, keys, k, by, point_rows, query_rows, max_train_rows)
    kept = [*by, *keys, "y"]
    return found.select(*kept, F.explode(F.arrays_zip("d", "label", "copies")).alias("n")).select(*kept, "n.*")


def nearest(
    train: DataFrame,
    queries: DataFrame,
    features: list[str],
    keys: list[str],
    k: int,
    by: list[str] = ["round", "fold"],
    point_rows: int = POINT_ROWS,
    query_rows: int = QUERY_ROWS,
    max_train_rows: int | None = None,
) -> DataFrame:
    """What `neighbours` gives, as one row per query: (by, keys, y) and arrays d, label, copies, nearest first."""
    query = queries.select(*by, *keys, F.col("label").cast("int").alias("y"), *features)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by)) - 1  # one row per group
    asked = stage(_sizes(query, by, "queries").withColumn(CELL_OF, number))
    merged = _merge_copies(train, features, by).join(F.broadcast(asked.select(*by, CELL_OF)), by).drop(*by)
    release(train.sparkSession)  # what the tables before left: points are the next large thing on disk
    points = _shared(merged)
    sizes = asked.join(F.broadcast(_sizes(points, [CELL_OF], "points")), CELL_OF)
    if max_train_rows is not None:
        share = max_train_rows / F.col("points")
        even = F.pmod(F.xxhash64(F.lit(1), *features), F.lit(1 << 30)) / float(1 << 30)
        points = _shared(points.join(F.broadcast(sizes), CELL_OF).where(even < share).select(*points.columns))
    cut = stage(_block_counts(sizes, [*by, CELL_OF], point_rows, query_rows))
    blocks = cut.agg(F.sum("query_blocks")).first()[0] or 1
    files: dict[int, list[str]] = {}
    for name in sorted(points.inputFiles()):
        files.setdefault(int(re.search(f"/{CELL_OF}=([0-9]+)/", name)[1]), []).append(name)
    block = [CELL_OF, PART_OF]
    kept = [*by, *keys, "y"]
    mine = F.pmod(F.xxhash64(*keys), F.col("query_blocks")).cast("int").alias(PART_OF)
    dealt = query.join(F.broadcast(cut), by).select(*query.columns, CELL_OF, mine)
    # Many more partitions than blocks, so that few share one; a number given is not coalesced to fewer.
    dealt = dealt.repartition(8 * blocks, *block)

    def search(table: pa.Table) -> pa.Table:
        held = _point_blocks(files.get(table.column(CELL_OF)[0].as_py(), []), features, point_rows)
        found = _nearest_of(_matrix(table, features), held, k)
        return _answers(table.select(kept), found, k)

    schema = T.StructType([query.schema[c] for c in kept] + _BEST)
    return dealt.groupBy(*block).applyInArrow(search, schema)


def _shared(points: DataFrame) -> DataFrame:
    """`points` as files of one group each in the folder that all tasks read."""
    path = new_folder(points.sparkSession, "points")
    points.write.partitionBy(CELL_OF).parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)


def _matrix(table, features: list[str]) -> np.ndarray:
    out = np.empty((table.num_rows, len(features)))
    for j, c in enumerate(features):
        out[:, j] = table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy()
    return out


def _point_blocks(files: list[str], features: list[str], rows: int) -> Iterator[tuple]:
    """(points, label, copies) of the files' rows, so many at a time."""
    held, size = [], 0
    for name in files:
        with open_shared(name) as source:
            for batch in pq.ParquetFile(source).iter_batches(min(rows, 1 << 16), columns=["label", "copies", *features]):
                while size + batch.num_rows >= rows:
                    held.append(batch.slice(0, rows - size))
                    batch = batch.slice(rows - size)
                    size = 0
                    yield _block(held, features)
                if batch.num_rows:
                    held.append(batch)
                    size += batch.num_rows
    if held:
        yield _block(held, features)


def _block(held: list[pa.RecordBatch], features: list[str]) -> tuple:
    """(points, label, copies) of the batches, which are let go."""
    table = pa.Table.from_batches(held)
    held.clear()
    return _matrix(table, features), table.column("label").to_numpy().copy(), table.column("copies").to_numpy().copy()


def _answers(rows: pa.Table, found: Found, k: int) -> pa.Table:
    """`rows` with their neighbours as lists; rows without any are left out, those of equal keys are one row of the k best."""
    row, distance, label, copies = found
    first = np.arange(rows.num_rows)
    groups = rows.append_column("_at", pa.array(first)).group_by(rows.column_names).aggregate([("_at", "min"), ("_at", "list")])
    if groups.num_rows < rows.num_rows:
        lists = groups.column("_at_list").combine_chunks()
        first[lists.flatten().to_numpy()] = np.repeat(groups.column("_at_min").to_numpy(), pc.list_value_length(lists).to_numpy())
        row = first[row]
        order = np.lexsort((copies, label, distance, row))
        row, distance, label, copies = row[order], distance[order], label[order], copies[order]
        near = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, distance, label, copies = row[near], distance[near], label[near], copies[near]
    there = np.unique(row)
    edges = np.append(np.searchsorted(row, there), len(row)).astype(np.int32)
    out = rows.take(pa.array(there))
    for name, values in (("d", distance), ("label", label.astype(np.int32)), ("copies", copies.astype(np.int64))):
        out = out.append_column(name, pa.ListArray.from_arrays(pa.array(edges), pa.array(values)))
    return out


def _block_counts(sizes: DataFrame, by: list[str], point_rows: int, query_rows: int) -> DataFrame:
    """(by, point_blocks, query_blocks): enough for the rows they may hold; of queries also for every core to have some.

    Each block of queries more reads the points and builds a tree of them once more, so their number goes by cores,
    not by shuffle partitions.
    """
    tasks = TURNS * sizes.sparkSession.sparkContext.defaultParallelism
    groups = Window.partitionBy(F.lit(0))
    return sizes.select(
        *by,
        F.ceil(F.col("points") / point_rows).cast("int").alias("point_blocks"),
        F.greatest(F.ceil(F.col("queries") / query_rows), F.ceil(tasks / F.count(F.lit(1)).over(groups)))
        .cast("int")
        .alias("query_blocks"),
    )


def _sizes(df: DataFrame, by: list[str], name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def _voted(near: DataFrame, kept: list[str], answer: list[T.StructField], vote: Callable) -> DataFrame:
    """`near` of `neighbours` or `nearest` with the columns that `vote` makes of each query's (d, label, copies), filled up with 0 copies."""
    if not isinstance(near.schema["d"].dataType, T.ArrayType):
        near = near.groupBy(*kept).agg(F.sort_array(F.collect_list(F.struct("d", "label", "copies"))).alias("n"))
        near = near.select(*kept, *(F.col("n")[c].alias(c) for c in ("d", "label", "copies")))
    names = [f.name for f in answer]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("d")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            filled = []
            for c in ("d", "label", "copies"):
                wide = np.zeros((len(size), size.max(initial=0)))
                wide[row, at] = batch.column(c).flatten().to_numpy(zero_copy_only=False)
                filled.append(wide)
            made = vote(*filled)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, *names])

    schema = T.StructType([near.schema[c] for c in kept] + answer)
    return near.select(*kept, "d", "label", "copies").mapInArrow(run, schema)


def _used(copies: np.ndarray, k: int) -> np.ndarray:
    """How many of each neighbour's copies are among the k nearest."""
    before = np.cumsum(copies, axis=1) - copies
    return np.maximum(np.minimum(copies, k - before), 0)


def vote_distance(near: DataFrame, k: int, keys: list[str], by=["round", "fold"]) -> DataFrame:
    """Labels weighted by 1 / distance; where a distance is 0 only such neighbours vote.

    The larger sum wins, the smaller label among equals.
    """

    def vote(d: np.ndarray, label: np.ndarray, copies: np.ndarray) -> list[pa.Array]:
        used = _used(copies, k)
        same = (used > 0) & (d == 0)
        only = same.any(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(only[:, None], np.where(same, used, 0.0), np.where((used > 0) & (d > 0), used / d, 0.0))
        one, zero = np.zeros(len(d)), np.zeros(len(d))
        for j in range(d.shape[1]):  # sums from the nearest on, whatever the lists' length
            one += np.where(label[:, j] == 1, weight[:, j], 0.0)
            zero += np.where(label[:, j] == 0, weight[:, j], 0.0)
        return [pa.array((one > zero).astype(np.int32))]

    return _voted(near, [*by, *keys, "y"], [T.StructField("p", T.IntegerType(), False)], vote)


def vote_uniform(
    near: DataFrame, ks: list[int], keys: list[str], by=["round", "fold"]
) -> DataFrame:
    """Plain majority among the k nearest, for every k of `ks`, numbered by `config`."""
    kept = [*by, *keys, "y"]

    def vote(d: np.ndarray, label: np.ndarray, copies: np.ndarray) -> list[pa.Array]:
        p = np.empty((len(d), len(ks)), np.int32)
        for at, k in enumerate(ks):
            used = _used(copies, k)
            p[:, at] = (used * (label == 1)).sum(axis=1) > (used * (label == 0)).sum(axis=1)
        edges = np.arange(0, p.size + 1, len(ks), dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(edges), pa.array(p.ravel()))]

    # One pass over the neighbours serves all k.
    voted = _voted(near, kept, [T.StructField("votes", T.ArrayType(T.IntegerType(), False), False)], vote)
    voted = voted.select(*kept, F.posexplode("votes").alias("config", "p"))
    return voted.select(*kept, "config", F.get(F.lit(ks), F.col("config")).alias("k"), "p")
