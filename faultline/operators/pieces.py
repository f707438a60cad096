"""Window statistics where the readings lie: each task summarises the windows inside its run of sorted readings.

Readings are dealt out once by ranges of (recording, order) and staged sorted, every row with its place in its
recording's part of the range. How many rows of a recording lie in earlier ranges is one number per range, for the
recording that crosses into it. So a task that reads a run of the stage, wherever a file was split, knows every
row's position, and gives out the windows that lie inside the run. Only rows near a run's ends, at most a
window and a step of them, are exchanged, for the windows that cross. A sliding window is a view of the values: a
row is neither copied per window nor sent twice, however small the step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from faultline.schema import RECORDING
from faultline.session import stage

#: Values of windows that are summarised at once.
CELLS = 2_000_000
#: Rows of whole runs that are summarised at once.
HELD = 50_000
#: Windows that share a row, from which on their statistics are carried from window to window.
DENSE = 16


def _new_recording(batch: pa.RecordBatch, before: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row's recording differs from that of the row before it."""
    out = np.zeros(batch.num_rows, bool)
    for c in RECORDING:
        column = batch.column(batch.schema.get_field_index(c))
        last = pa.nulls(1, column.type) if before is None else before.column(before.schema.get_field_index(c)).slice(before.num_rows - 1)
        shifted = pa.concat_arrays([last, column.slice(0, len(column) - 1)])
        same = pc.fill_null(pc.equal(column, shifted), False)
        both = pc.and_(pc.is_null(column), pc.is_null(shifted))
        out |= ~np.asarray(pc.or_(same, both))
    if before is None and len(out):
        out[0] = True
    return out


def arranged(readings: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """`readings` staged in ranges of (recording, order), sorted, with `piece`, the range, `at`, the row's place in
    it, and `local`, its place among the rows of its recording there; without the order columns."""
    spark = readings.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in readings.columns if c not in order]
    numbers = [("piece", T.IntegerType()), ("at", T.LongType()), ("local", T.LongType())]
    schema = T.StructType([readings.schema[c] for c in kept] + [T.StructField(n, t) for n, t in numbers])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        piece, at, first, before = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = at + np.arange(batch.num_rows)
            begins = np.where(_new_recording(batch, before), place, -1)
            begins[0] = max(begins[0], first)
            begins = np.maximum.accumulate(begins)
            added = [np.full(len(place), piece, np.int32), place, place - begins]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, added)], names=[*kept, "piece", "at", "local"])
            at, first, before = at + batch.num_rows, int(begins[-1]), batch

    dealt = readings.repartitionByRange(parts, *RECORDING, *order).sortWithinPartitions(*RECORDING, *order)
    return stage(dealt.select(*kept).mapInArrow(number, schema))


def _statistics(cells: np.ndarray, names: list[str], missing: bool) -> dict[str, np.ndarray]:
    """Statistics of each row of a matrix; NaN where there are none. Absent values are left out, or with
    `missing` leave their window without any."""
    absent = np.isnan(cells)
    some = absent.any()
    count = cells.shape[1] - absent.sum(axis=1) if some else np.full(len(cells), cells.shape[1])
    with np.errstate(all="ignore"):
        if not some:
            mean = cells.mean(axis=1)
            found = {"max": cells.max(axis=1), "min": cells.min(axis=1), "median": np.median(cells, axis=1), "mean": mean}
            squares = ((cells - mean[:, None]) ** 2).sum(axis=1)
        else:
            mean = np.where(absent, 0, cells).sum(axis=1) / count
            ordered = np.sort(cells, axis=1)  # NaN goes last
            row, last = np.arange(len(cells)), np.maximum(count - 1, 0)
            middle = (ordered[row, last // 2] + ordered[row, (last + 1) // 2]) / 2
            found = {"max": ordered[row, last], "min": ordered[:, 0], "median": middle, "mean": mean}
            squares = (np.where(absent, 0, cells - mean[:, None]) ** 2).sum(axis=1)
        found["var"] = np.where(count > 1, squares / (count - 1), np.nan)
        found["std"] = np.sqrt(found["var"])
    if missing and some:
        found = {n: np.where(count < cells.shape[1], np.nan, x) for n, x in found.items()}
    return {n: found[n] for n in names}


def _rolling(column: np.ndarray, size: int, names: list[str]) -> dict[str, np.ndarray]:
    """Statistics of the window that begins at each row; no value is absent or infinite.

    Rows are cut into blocks as long as a window. A window is the end of one block and the beginning of the next, so
    what runs up to each row from either side of its block is merged, and nothing is ever subtracted.
    """
    n = len(column)
    blocks = np.zeros((-(-n // size), size))
    blocks.ravel()[:n] = column
    begin = np.arange(n - size + 1)
    end, split = begin + size - 1, begin % size != 0
    found = {}
    for name, reach in (("max", np.maximum), ("min", np.minimum)):
        if name in names:
            after = reach.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[begin]
            until = reach.accumulate(blocks, axis=1).ravel()[end]
            found[name] = np.where(split, reach(after, until), until)
    if "median" in names:
        found["median"] = pd.Series(column).rolling(size).median().to_numpy()[end]
    until = np.cumsum(blocks, axis=1).ravel()[end]
    after = np.cumsum(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[begin]
    found["mean"] = np.where(split, after + until, until) / size
    if "var" in names or "std" in names:
        first, squares = _running_squares(blocks)
        last, others = (x[:, ::-1].ravel()[begin] for x in _running_squares(blocks[:, ::-1]))
        first, squares = first.ravel()[end], squares.ravel()[end]
        later = begin % size
        merged = squares + others + (first - last) ** 2 * (later * (size - later) / size)
        found["var"] = np.where(split, merged, squares) / (size - 1)
        found["std"] = np.sqrt(found["var"])
    return {n: found[n] for n in names}


def _running_squares(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of a block: mean, and sum of squared deviations, of the block up to it."""
    across = np.ascontiguousarray(blocks.T)
    mean, squares = np.empty_like(across), np.empty_like(across)
    now, total = np.zeros(across.shape[1]), np.zeros(across.shape[1])
    for at, x in enumerate(across):
        gap = x - now
        now = now + gap / (at + 1)
        total = total + gap * (x - now)
        mean[at], squares[at] = now, total
    return mean.T, squares.T


def _windowed(column: np.ndarray, begin: np.ndarray, size: int, step: int, names: list[str], missing: bool) -> dict[str, np.ndarray]:
    """Statistics of the windows that begin at the rows `begin`."""
    if size >= DENSE * step and len(begin) >= len(column) // (4 * step) and np.isfinite(column).all():
        made = _rolling(column, size, names)
        return {name: x[begin] for name, x in made.items()}
    views = np.lib.stride_tricks.sliding_window_view(column, size)
    each = max(1, CELLS // size)
    found = [_statistics(views[begin[a : a + each]], names, missing) for a in range(0, len(begin), each)]
    return {name: np.concatenate([f[name] for f in found]) for name in names}


def _summaries(rows: pa.Table, start: np.ndarray, first: np.ndarray, ended: np.ndarray, shape: tuple, columns: tuple):
    """Of runs of rows of one recording each: their windows, and their rows near the ends that windows may cross.

    A run begins at row `start` with its recording's position `first`; `ended` says that the recording ends with it.
    """
    size, step, drop_last, missing = shape
    fixed, variables, names = columns
    n = np.diff(np.append(start, rows.num_rows))
    stop, extra = first + n, step if drop_last else 0
    low = -(-first // step)
    last = np.where(ended, np.maximum((stop - size) // step - (1 if drop_last else 0), 0), (stop - size - extra) // step)
    number = np.maximum(np.minimum(last, (stop - size) // step) - low + 1, 0)
    short = ended & (first == 0) & (stop < size)
    number[short] = 0
    run = np.repeat(np.arange(len(start)), number)
    w = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
    begin = start[run] + w * step - first[run]
    # Recordings shorter than a window, by their length.
    brief = np.flatnonzero(short)
    brief = brief[np.argsort(n[brief], kind="stable")]
    lengths = np.split(brief, np.flatnonzero(np.diff(n[brief])) + 1) if len(brief) else []
    windows = None
    values = {v: _floats(rows.column(v)) for v in variables}
    if len(w) or len(brief):
        windows = rows.select(fixed).take(pa.array(np.append(start[run], start[brief])))
        windows = windows.append_column("w", pa.array(np.append(w, np.zeros(len(brief), np.int64))))
        for v in variables:
            found = [_windowed(values[v], begin, size, step, names, missing)] if len(w) else []
            found += [_statistics(values[v][start[same][:, None] + np.arange(n[same[0]])], names, missing) for same in lengths]
            for name in names:
                made = np.concatenate([f[name] for f in found])
                windows = windows.append_column(f"{v}_{name}", pa.array(made, from_pandas=True))
    each = np.repeat(np.arange(len(start)), n)
    pos = first[each] + np.arange(len(each)) - start[each]
    near = ((first > 0)[each] & (pos < (first + size + extra)[each])) | (~ended[each] & (pos >= (stop - size - extra)[each]))
    if not near.any():
        return windows, None
    at = np.flatnonzero(near)
    edge = rows.select([*fixed, *variables]).take(pa.array(at))
    for name, x in (("pos", pos[at]), ("run_first", first[each[at]]), ("run_stop", stop[each[at]]), ("ended", ended[each[at]])):
        edge = edge.append_column(name, pa.array(x))
    return windows, edge


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.to_numpy(zero_copy_only=False).astype(float) for c in column.chunks])


def window_features(
    readings: DataFrame,
    size: int,
    step: int,
    variables: list[str],
    keep: tuple[str, ...],
    names: list[str],
    order: list[str],
    drop_last: bool,
    missing: bool,
    parts: int | None,
    assign,
    summarise,
) -> DataFrame:
    """One row per window inside each recording. `assign` and `summarise` see to the windows that cross."""
    fixed = [*RECORDING, *keep]
    placed = arranged(readings.select(*fixed, *order, *variables), order, parts)
    counts = placed.groupBy(*RECORDING, "piece").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*RECORDING).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    crossed = counts.withColumn("before", F.sum("n").over(earlier)).where(F.col("before") > 0)
    # A range begins inside one recording at most: a number per range.
    before = {r.piece: r.before for r in crossed.select("piece", "before").collect()}
    shape, columns = (size, step, drop_last, missing), (fixed, variables, names)
    features = [f"{v}_{n}" for v in variables for n in names]
    fields = [placed.schema[c] for c in fixed] + [T.StructField("w", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in features] + [T.StructField(v, T.DoubleType()) for v in variables]
    fields += [T.StructField(c, T.LongType()) for c in ("pos", "run_first", "run_stop")] + [T.StructField("ended", T.BooleanType())]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        marks: list[tuple] = []
        last: tuple[int, int] | None = None
        previous, shown = None, None
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if shown is None:
                shown = pa.schema([batch.schema.field(c) for c in fixed] + [pa.field(f.name, _PLAIN[type(f.dataType)]) for f in fields[len(fixed) :]])
            piece, at, local = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("piece", "at", "local"))
            follows = np.empty(len(at), bool)
            follows[1:] = (piece[1:] == piece[:-1]) & (at[1:] == at[:-1] + 1)
            follows[0] = last == (int(piece[0]), int(at[0]) - 1)
            start = np.flatnonzero(_new_recording(batch, previous) | ~follows)
            carried = np.array([before.get(p, 0) for p in piece[start].tolist()], np.int64)
            first = local[start] + np.where(at[start] == local[start], carried, 0)
            held.append(batch)
            marks.append((rows + start, first, follows[start]))
            rows += batch.num_rows
            last, previous = (int(piece[-1]), int(at[-1])), batch
            if len(start) and rows + start[-1] - batch.num_rows >= HELD:
                # All runs but the last are whole. One whose next row is another recording's has ended there.
                begin, first, ends = (np.concatenate(x) for x in zip(*marks))
                table, cut = pa.Table.from_batches(held), int(begin[-1])
                yield from _shown([_summaries(table.slice(0, cut), begin[:-1], first[:-1], ends[1:], shape, columns)], shown)
                held, rows = table.slice(cut).to_batches(), rows - cut
                marks = [(np.zeros(1, np.int64), first[-1:], ends[-1:])]
        if held:
            begin, first, ends = (np.concatenate(x) for x in zip(*marks))
            done = _summaries(pa.Table.from_batches(held), begin, first, np.append(ends[1:], False), shape, columns)
            yield from _shown([done], shown)

    made = stage(placed.mapInArrow(run, schema))
    inside = made.where(F.col("w").isNotNull()).select(*fixed, "w", *features)
    edges = made.where(F.col("pos").isNotNull()).select(*fixed, *variables, "pos", "run_first", "run_stop", "ended")
    # The recording's rows in all, for the few recordings that have rows here.
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in RECORDING]
    totals = counts.groupBy(*RECORDING).agg(F.sum("n").alias("n_rows"))
    joined = edges.alias("e").join(totals.alias("t"), same).select("e.*", "t.n_rows")
    assigned = assign(joined, size, step, drop_last=drop_last)
    begin, extra = F.col("w") * step, step if drop_last else 0
    given: Column = (F.col("run_first") <= begin) & (F.col("ended") | (begin + size + extra <= F.col("run_stop")))
    crossing = summarise(assigned.where(~given), [*fixed, "w"], variables, missing=missing)
    if size >= DENSE * step:
        # A window of one row to the next: copies of rows per window are left to what no single end can settle.
        inner = edges.where((F.col("run_first") > 0) & ~F.col("ended"))
        shortest = inner.agg(F.min(F.col("run_stop") - F.col("run_first"))).first()[0]
        if shortest is None or shortest >= size + extra:
            whole = F.col("n_rows") >= size
            met = _across_ends(joined.where(whole), shape, columns, T.StructType(schema.fields[: len(fixed) + 1 + len(features)]))
            rest = assign(joined.where(~whole), size, step, drop_last=drop_last).where(~given)
            brief = summarise(rest, [*fixed, "w"], variables, missing=missing)
            crossing = met.unionByName(brief.select(*fixed, "w", *features))
    return inside.unionByName(crossing.select(*fixed, "w", *features))


def _across_ends(edges: DataFrame, shape: tuple, columns: tuple, schema: T.StructType) -> DataFrame:
    """The windows that cross the end of a run, summarised where the rows on its two sides meet.

    Runs between two ends are at least a window and a step long, so a window crosses one end only.
    """
    size, step, drop_last, missing = shape
    fixed, variables, names = columns
    extra = step if drop_last else 0
    pos, begin, stop = F.col("pos"), F.col("run_first"), F.col("run_stop")
    after = F.when((begin > 0) & (pos < begin + size + extra), begin)
    until = F.when(~F.col("ended") & (pos >= stop - size - extra), stop)
    met = edges.withColumn("end", F.explode(F.array_compact(F.array(after, until))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        end, n, base = (table.column(c)[0].as_py() for c in ("end", "n_rows", "pos"))
        last = max((n - size) // step - (1 if drop_last else 0), 0)
        w = np.arange(max(-(-(end - size - extra + 1) // step), 0), min((end - 1) // step, last) + 1)
        out = table.select(fixed).take(pa.array(np.zeros(len(w), np.int64))).append_column("w", pa.array(w, pa.int64()))
        for v in variables:
            made = _windowed(_floats(table.column(v)), w * step - base, size, step, names, missing) if len(w) else {}
            for name in names:
                out = out.append_column(f"{v}_{name}", pa.array(made.get(name, np.zeros(0)), pa.float64(), from_pandas=True))
        return out

    return met.groupBy(*RECORDING, "end").applyInArrow(run, schema)


_PLAIN = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_()}


def _shown(done: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Windows and edge rows in one shape, the other's columns null."""
    for kind in (0, 1):
        tables = [x[kind] for x in done if x[kind] is not None]
        if tables:
            table = pa.concat_tables(tables).combine_chunks()
            columns = [table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in schema]
            yield from pa.table(columns, schema=schema).to_batches()
