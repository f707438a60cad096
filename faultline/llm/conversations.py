"""Conversations brought to alternating turns by the cheapest edits.

A repaired conversation is empty or has the role initials `s?(ua)+`. Each row is kept (K, free), given the role
user or assistant (R, 2) or deleted (D, 3, a must where it is blank or repeats an earlier row of its conversation);
empty user and assistant turns may be put in anywhere (I, 2); a row that ends in the middle of a sentence costs 1 if
it stays. Of the cheapest edits those whose letters come first in ASCII count.

The search is a Viterbi walk over four states: nothing yet, a system turn, a user turn, an assistant turn. Every
state's survivor is a leaf of a tree of back pointers. A node nobody points at is freed, and once all survivors
share an ancestor the edits up to it are settled and leave the tree, so it holds the unsettled rows alone. Equal costs
are decided by the whole unsettled edits: as letters that end a row are never inserts, two survivors' edits
never are one the start of the other, so once they differ their order holds, and a rank per survivor carries the
comparison on. A survivor that another one can imitate for less is dropped, which bounds differences of cost: the
walk's steps repeat and are kept.

Rows are ordered by sampled ranges on their keys alone, without their texts, so a conversation of any length is
cut into pieces that many tasks share. A conversation inside one piece is walked at once. For others each piece is
walked from all four states, the pieces' costs and ranks are folded, a few numbers a piece, and each piece is walked
again between the states found.

Edge cases: null roles and texts count as one space, null turns come first, rows of one turn by role and text digest;
a null conv_id is a conversation of its own; equal rows are duplicates of the first; a conversation without rows has
no edits; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from faultline.llm.common import Stages, grouped, partitions_for, task
from faultline.operators.ordering import ordered

# What edits cost.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: `[\x20\x09-\x0D]`.
BLANKS = " \t\n\x0b\x0c\r"
ROWS_EACH = 100_000

# ---- the walk ------------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
_INITIAL = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that end a conversation from each state.
_MISSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: _IMITATE[x][y]: whatever follows y can follow x, changed at this cost at most. From anywhere else one insert
#: reaches a turn; a system turn that only START may keep is deleted; after SYSTEM a pair must come.
_IMITATE = {
    START: {SYSTEM: 0, ASSISTANT: 0, USER: INSERT},
    SYSTEM: {START: 2 * INSERT, ASSISTANT: 2 * INSERT, USER: INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT},
}
#: Symbol of a row that must go; others are the role's initial (o: none of s, u, a), a capital if truncated.
GONE = "x"


@lru_cache(None)
def _moves(state: int, symbol: str) -> list[tuple[str, int, int]]:
    """(edits, state, cost) of every way past one row, inserts before it."""
    out, cost = [], 0
    for inserts in ("", "I", "II"):
        if inserts:
            state, cost = _NEXT[state], cost + INSERT
        out.append((inserts + "D", state, cost + DELETE))
        if symbol == GONE:
            continue
        letter, stays = symbol.lower(), cost + (TRUNCATED if symbol.isupper() else 0)
        if letter == "s" and state == START:
            out.append((inserts + "K", SYSTEM, stays))
        if letter == _INITIAL[_NEXT[state]]:
            out.append((inserts + "K", _NEXT[state], stays))
        else:
            out.append((inserts + "R", _NEXT[state], stays + RENAME))
    return out


Survivors = tuple[tuple[int, int], ...]
"""(state, cost) of each survivor, in the order of their whole edits, costs above the least."""


@lru_cache(1 << 16)
def _step(survivors: Survivors, symbol: str) -> tuple[Survivors, tuple[tuple[int, str], ...], int]:
    """The survivors after a row, each one's (rank before, edits), and by how much the least cost grew."""
    best: dict[int, tuple[int, int, str]] = {}
    for rank, (state, cost) in enumerate(survivors):
        for edits, to, price in _moves(state, symbol):
            found = (cost + price, rank, edits)
            if to not in best or found < best[to]:
                best[to] = found
    kept = [
        (rank, edits, to, cost)
        for to, (cost, rank, edits) in best.items()
        if all(best[x][0] + _IMITATE[x][to] >= cost for x in best if x != to)
    ]
    kept.sort()
    least = min(cost for *_, cost in kept)
    return (
        tuple((to, cost - least) for _, _, to, cost in kept),
        tuple((rank, edits) for rank, edits, _, _ in kept),
        least,
    )


class _Node:
    """A row's edits on the way to a survivor; `children` are the references that keep it."""

    __slots__ = ("parent", "edits", "children")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.children = parent, edits, []
        if parent is not None:
            parent.children.append(self)

    def release(self) -> None:
        """Free the node, and whatever only it kept, unless something points at it."""
        node = self
        while node.parent is not None and not node.children:
            node.parent.children.remove(node)
            node = node.parent


def _last(survivors: Survivors) -> tuple[int, int]:
    """The (rank, missing inserts) of the survivor that ends cheapest and first."""
    _, rank = min((cost + INSERT * _MISSING[state], rank) for rank, (state, cost) in enumerate(survivors))
    return rank, _MISSING[survivors[rank][0]]


def settled(symbols: str, start: int = START, end: int | None = None) -> Iterator[str]:
    """The edits of each row in turn, given out once no survivor differs in them.

    `end` names the state to finish in; None finishes the conversation, the missing turns a last text of their own.
    """
    root = _Node(None, "")
    alive, survivors = [root], ((start, 0),)
    for symbol in symbols:
        survivors, chosen, _ = _step(survivors, symbol)
        grown = [_Node(alive[rank], edits) for rank, edits in chosen]
        for node in alive:
            node.release()
        alive = grown
        while len(root.children) == 1:
            root = root.children[0]
            root.parent = None
            yield root.edits
    rank, missing = _last(survivors) if end is None else ([s for s, _ in survivors].index(end), 0)
    rest, node = [], alive[rank]
    while node is not root:
        rest.append(node.edits)
        node = node.parent
    yield from reversed(rest)
    if missing:
        yield "I" * missing


@lru_cache(1 << 14)
def _short(symbols: str) -> list[str]:
    return _edits(symbols)


def _edits(symbols: str, start: int = START, end: int | None = None) -> list[str]:
    """One text of edits per row; missing turns join the last row's."""
    out = list(settled(symbols, start, end))
    if len(out) > len(symbols):
        missing = out.pop()
        out[-1] += missing
    return out


def crossings(symbols: str) -> list[list[tuple[int, int]]]:
    """For each start state, the (state, cost) of the survivors of these rows, in the order of their edits."""
    out = []
    for start in range(4):
        survivors, total = ((start, 0),), 0
        for symbol in symbols:
            survivors, _, grown = _step(survivors, symbol)
            total += grown
        out.append([(state, cost + total) for state, cost in survivors])
    return out


def joined(pieces: list[list[list[tuple[int, int]]]]) -> list[tuple[int, int | None]]:
    """The (start, end) states of each piece on the cheapest and first way through all; the last ends open."""
    survivors, back = [(START, 0)], []
    for crossing in pieces:
        best: dict[int, tuple[int, int, int]] = {}
        for rank, (state, cost) in enumerate(survivors):
            for inner, (to, price) in enumerate(crossing[state]):
                found = (cost + price, rank, inner)
                if to not in best or found < best[to]:
                    best[to] = found
        order = sorted((rank, inner, to, cost) for to, (cost, rank, inner) in best.items())
        back.append([(rank, survivors[rank][0], to) for rank, _, to, _ in order])
        least = min(cost for *_, cost in order)
        survivors = [(to, cost - least) for _, _, to, cost in order]
    rank, _ = _last(tuple(survivors))
    out: list[tuple[int, int | None]] = []
    for links in reversed(back):
        rank, start, end = links[rank]
        out.append((start, end if out else None))
    return out[::-1]


# ---- rows and their faults -----------------------------------------------------------------------

KEYS = ["conv", "turn", "role_key", "digest", "row"]


def _keyed(conversations: DataFrame) -> DataFrame:
    """The rows with the keys that order them; `row` tells equal ones apart."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"),
        "conv_id",
        "turn",
        F.substring(role, 1, 60).alias("role_key"),
        F.unhex(F.md5(whole)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        role.alias("role"),
        text.alias("text"),
    )


def _symbol(role: Column, text: Column) -> Column:
    ended = F.rtrim(text, F.lit(BLANKS))
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    is_open = ~F.right(ended, F.lit(1)).isin(".", "!", "?")
    return F.when(ended == "", GONE).when(is_open, F.upper(letter)).otherwise(letter)


class Repair:
    """The faults and edits of every row, and the conversations they lead to."""

    def __init__(self, conversations: DataFrame, parts: int | None = None):
        self.spark = conversations.sparkSession
        self.stages = Stages(self.spark, "conversations")
        self.rows = self.stages.keep(_keyed(conversations), "rows")
        self.parts = parts or partitions_for(self.spark, self.rows.count(), ROWS_EACH)
        self.edits = self.stages.keep(self._find(), "edits")

    def _find(self) -> DataFrame:
        """(conv, turn, role_key, digest, row, fault, edits), a row per row of the conversations."""
        narrow = self.rows.select(*KEYS, _symbol(F.col("role"), F.col("text")).alias("symbol"))
        placed = ordered(narrow, KEYS[:1], KEYS[1:], self.parts)
        firsts = placed.groupBy("conv", "digest").agg(F.min("at").alias("first_at"))
        blank, again = F.col("symbol") == GONE, F.col("at") > F.col("first_at")
        fault = F.when(blank, "blank").when(again, "duplicate")
        fault = fault.when(F.upper("symbol") == F.col("symbol"), "truncated")
        marked = placed.join(firsts, ["conv", "digest"]).select(
            *KEYS, "piece", "at", fault.alias("fault"), F.when(again, GONE).otherwise(F.col("symbol")).alias("symbol")
        )
        # At most a piece's rows: one recording of a piece makes one list.
        item = F.struct("at", *KEYS[1:], "fault", "symbol")
        listed = marked.groupBy("conv", "piece").agg(F.sort_array(F.collect_list(item)).alias("items"))
        chunks = listed.withColumn("symbols", F.array_join(F.transform("items", lambda x: x["symbol"]), ""))
        chunks = self.stages.keep(chunks, "chunks")
        cut = chunks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("conv")
        none = F.lit(None).cast("int")
        whole = chunks.join(cut, "conv", "left_anti").withColumns({"start": F.lit(START), "end": none})
        crossed = chunks.join(cut, "conv", "left_semi").select("conv", "piece", "symbols").mapInArrow(_cross, _CROSSED)
        ways = crossed.groupBy("conv").applyInArrow(_join, "conv string, piece int, start int, end int")
        split = chunks.join(ways, ["conv", "piece"])
        todo = whole.unionByName(split).select("conv", "start", "end", "symbols", "items")
        kind = todo.schema["items"].dataType
        schema = T.StructType([T.StructField("conv", T.StringType()), T.StructField("items", kind), T.StructField("edits", T.ArrayType(T.StringType()))])
        each = todo.mapInArrow(_solve, schema).select("conv", F.explode(F.arrays_zip("items", "edits")).alias("each"))
        return each.select("conv", *(F.col(f"each.items.{c}").alias(c) for c in [*KEYS[1:], "fault"]), F.col("each.edits").alias("edits"))

    def lines(self) -> DataFrame:
        """(conv_id, turn, role, text, fault, edits): the rows and what is done to each; rows are not ordered."""
        return self.rows.join(self.edits.select("row", "fault", "edits"), "row").select(
            "conv_id", "turn", "role", "text", "fault", "edits"
        )

    def audits(self) -> DataFrame:
        """One row per conversation that has rows: its faults, edits, their cost, and the repaired text's digest.

        Rows and their edits meet by being sorted together, and pass through one task per conversation as a
        stream: a digest of a whole text can be taken in no other way. Nothing but the edits' letters is gathered.
        """
        texts = self.rows.select(
            *KEYS, F.lit(1).alias("kind"), "conv_id", "role", "text", F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("edits")
        )
        empty = {c: F.lit(None).cast(self.rows.schema[c].dataType) for c in ("conv_id", "role", "text")}
        edits = self.edits.withColumns({"kind": F.lit(0), **empty}).select(*texts.columns)
        merged = edits.unionByName(texts).repartition(self.parts, "conv").sortWithinPartitions(*KEYS, "kind")
        fields = [T.StructField("conv", T.StringType()), T.StructField("conv_id", self.rows.schema["conv_id"].dataType)]
        fields += [T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        fields += [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")]
        narrow = merged.select("conv", "conv_id", "turn", "kind", "role", "text", "fault", "edits")
        return narrow.mapInArrow(_audit, T.StructType(fields))


_CROSSED = "conv string, piece int, crossing string"


@task
def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [";".join(",".join(f"{s}:{c}" for s, c in way) for way in crossings(x)) for x in batch.column("symbols").to_pylist()]
        yield pa.record_batch({"conv": batch.column("conv"), "piece": batch.column("piece"), "crossing": pa.array(found, pa.string())})


@grouped
def _join(table: pa.Table) -> pa.Table:
    table = table.sort_by("piece")
    pieces = [
        [[tuple(map(int, pair.split(":"))) for pair in way.split(",")] for way in text.split(";")]
        for text in table.column("crossing").to_pylist()
    ]
    starts, ends = zip(*joined(pieces))
    return pa.table(
        {"conv": table.column("conv"), "piece": table.column("piece"), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())}
    )


@task
def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        edits = []
        for symbols, start, end in zip(*(batch.column(c).to_pylist() for c in ("symbols", "start", "end"))):
            short = len(symbols) <= 64 and start == START and end is None
            edits.append(_short(symbols) if short else _edits(symbols, start, end))
        yield pa.record_batch({"conv": batch.column("conv"), "items": batch.column("items"), "edits": pa.array(edits, pa.list_(pa.string()))})


class _Audit:
    """What is known of a conversation so far, as its rows pass."""

    def __init__(self, conv: str):
        self.conv, self.conv_id = conv, None
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.letters: list[str] = []
        self.digest, self.any = hashlib.sha256(), False
        self.state, self.edits, self.fault = START, "", None

    def decided(self, fault: str | None, edits: str) -> None:
        self.fault, self.edits = fault, edits
        if fault:
            self.faults[fault] += 1
        self.letters.append(edits)

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def turned(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        for edit in self.edits:
            if edit == "D":
                self.cost += DELETE
                continue
            if edit == "K" and role[:1] == "s":
                self.state = SYSTEM
            else:
                self.state = _NEXT[self.state]
            if edit == "I":
                self.cost += INSERT
                self.line(ROLES[_INITIAL[self.state]], "")
                continue
            self.cost += (TRUNCATED if self.fault == "truncated" else 0) + (RENAME if edit == "R" else 0)
            self.line(ROLES[_INITIAL[self.state]] if edit == "R" else role, text)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest())


_AUDIT = ["conv", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@task
def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Audit | None = None
    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        done = []
        for conv, conv_id, turn, text_row, role, text, fault, edits in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Audit(conv)
            if text_row:
                now.conv_id = conv_id
                now.turned(turn, role, text)
            else:
                now.decided(fault, edits)
        yield _audit_rows(done, kind)
    if now is not None:
        yield _audit_rows([now.row()], kind)


def _audit_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [pa.string(), kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    columns = zip(*rows) if rows else [[]] * len(_AUDIT)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], _AUDIT)


# ---- damage, to see it repaired ------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged rows (conv_id, turn, role, text): by crc32 of 'conv_id:turn' modulo 20, nulls one space,
    0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's."""
    one = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), one), F.lit(":"), F.coalesce(F.col("turn").cast("string"), one))
    kind = F.crc32(key) % 20
    role, text = F.coalesce("role", one), F.coalesce("text", one)
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (
        conversations.where(kind != 0)
        .select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
            copies.alias("_copy"),
        )
        .drop("_copy")
    )


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """The audits of `rows`, and one of zeros for each other conv_id of `conversations`."""
    ids = conversations.select("conv_id").distinct()
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    audits = Repair(rows).audits().drop("conv_id")
    out = ids.withColumn("conv", key).join(audits, "conv", "left").drop("conv")
    counts = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in _AUDIT[2:8]}
    texts = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return out.withColumns({**counts, **texts}).select("conv_id", *_AUDIT[2:])
