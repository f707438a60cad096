"""Conversation repair against all edit sequences of short conversations, and a plain walk of long ones."""

import gc
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from faultline.llm import conversations, queries

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def best_by_trying(symbols):
    """The least (cost, letters) over every sequence of edits with up to two inserts anywhere."""
    def ways(symbol):
        yield "D", "", 3
        if symbol != "x":
            stays = 1 if symbol.isupper() else 0
            yield "K", symbol.lower(), stays
            yield "R", "u", 2 + stays
            yield "R", "a", 2 + stays

    inserts = [i for n in range(3) for i in itertools.product("ua", repeat=n)]
    best = None
    for chosen in itertools.product(*(list(itertools.product(inserts, ways(s))) for s in symbols)):
        for tail in inserts:
            roles = "".join("".join(i) + role for i, (_, role, _) in chosen) + "".join(tail)
            if not GRAMMAR.match(roles):
                continue
            cost = sum(2 * len(i) + price for i, (_, _, price) in chosen) + 2 * len(tail)
            letters = "".join("I" * len(i) + edit for i, (edit, _, _) in chosen) + "I" * len(tail)
            best = min(best or (cost, letters), (cost, letters))
    return best


def best_by_walk(symbols):
    """The same by keeping each state's least whole (cost, letters): slow on long ones, without tree or ranks."""
    now = {0: (0, "")}
    for symbol in symbols:
        after = {}
        for state, (cost, letters) in now.items():
            for edits, to, price in conversations._moves(state, symbol):
                after[to] = min(after.get(to, (10**9, "")), (cost + price, letters + edits))
        now = after
    return min((c + 2 * conversations._MISSING[s], t + "I" * conversations._MISSING[s]) for s, (c, t) in now.items())


def cost_of(symbols, edits):
    cost = 0
    for symbol, text in zip(symbols, edits):
        cost += 2 * text.count("I") + 3 * text.count("D") + 2 * text.count("R")
        cost += symbol.isupper() and "D" not in text
    return cost


def test_all_short_conversations_of_every_kind_of_row():
    for n in range(1, 3):
        for symbols in itertools.product("suaoSUAOx", repeat=n):
            symbols = "".join(symbols)
            edits = conversations._edits(symbols)
            assert (cost_of(symbols, edits), "".join(edits)) == best_by_trying(symbols), symbols
    assert conversations._edits("") == []


def test_short_random_conversations():
    pick = random.Random(5)
    for _ in range(12):
        symbols = "".join(pick.choice("suaoSUAOx") for _ in range(3))
        edits = conversations._edits(symbols)
        assert (cost_of(symbols, edits), "".join(edits)) == best_by_trying(symbols), symbols


@pytest.mark.parametrize("letters", ["suaoSUAOx", "uaUA", "oO", "xo", "sxu", "ux", "uuua"])
def test_long_conversations_and_any_cut_of_them(letters):
    pick = random.Random(letters)
    for n in [*range(1, 40), 300]:
        symbols = "".join(pick.choice(letters) for _ in range(n))
        edits = conversations._edits(symbols)
        assert (cost_of(symbols, edits), "".join(edits)) == best_by_walk(symbols)
        cuts = [0, *sorted(pick.sample(range(1, n), min(n - 1, pick.randint(1, 5)))), n]
        pieces = [symbols[a:b] for a, b in itertools.pairwise(cuts)]
        ways = conversations.joined([conversations.crossings(p) for p in pieces])
        assert [e for p, way in zip(pieces, ways) for e in conversations._edits(p, *way)] == edits


def test_edits_are_given_out_early_and_the_tree_stays_small():
    """However long the conversation, only unsettled rows are held."""
    pick = random.Random(3)
    symbols = "".join(pick.choice("uauauaUAxs") for _ in range(20_000))
    taken = 0

    def watched():
        nonlocal taken
        for s in symbols:
            taken += 1
            yield s

    behind = 0
    for given, _ in enumerate(conversations.settled(watched()), 1):
        behind = max(behind, taken - given)
        if given % 5000 == 0:
            assert sum(isinstance(o, conversations._Node) for o in gc.get_objects()) < 2000
    assert behind < 200
    # Steps repeat: a few survivors' differences are all there are.
    assert conversations._step.cache_info().currsize < 5000


# ---- rows ----------------------------------------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else v for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_audit(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text of one conversation's rows."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    turns = [t for _, t, _, _ in rows if t is not None]
    faults, symbols, seen = [], "", set()
    for _, _, role, text in rows:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        left = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        symbols += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
    cost, audit = best_by_walk(symbols)
    lines, at, state = [], 0, ""
    for edit in audit:
        role, text = rows[at][2:] if edit != "I" else (None, "")
        at += edit != "I"
        if edit == "D":
            continue
        if not (edit == "K" and role[:1] == "s"):
            state = "assistant" if state == "user" else "user"
        lines.append(f"{role if edit == 'K' else state}:{text}")
    pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def plain_repaired(rows):
    damaged = plain_damage(rows)
    return {c: plain_audit([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}


def audits_of(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_query_against_the_plain_version(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = audits_of(queries.QUERIES["op12_conversations"](spark, folder))
    assert got == plain_repaired(rows)
    assert {kind for audit in got.values() for kind in audit[6]} == set("DIKR")


def wild(seed, conversations_, turns):
    pick = random.Random(seed)
    texts = ["Yes.", "No?", "well", " ", "", None, "Same. ", "end!\n", "é…", "a. b", "\x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "super"]
    return [
        (c, pick.choice([None, 0, 1, 2, 5, 9, 9]), pick.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1])[0], pick.choice(texts) if pick.random() < 0.5 else f"t{i}.")
        for c in conversations_
        for i in range(pick.randint(1, turns))
    ]


def test_wild_rows_null_ids_nulls_ties_and_clashing_names(spark):
    rows = wild(1, [None, *range(-3, 40)], 9)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_repaired(rows)
    assert audits_of(conversations.repaired(df, conversations.damage(df))) == want
    more = df.withColumns({"row": F.lit(1), "digest": F.lit("x"), "CONV": F.lit(2), "kind": F.lit(3), "at": F.lit(4), "_copy": F.lit(5)})
    assert audits_of(conversations.repaired(more, conversations.damage(more))) == want


def test_one_conversation_in_a_third_of_the_rows_is_cut_into_pieces(spark):
    """Pieces walked apart give what one walk gives, with faults across them."""
    hot = [(7, t, r, x) for t, (_, _, r, x) in enumerate(wild(2, [7] * 400, 3))]
    rows = hot + wild(3, range(20, 120), 8)
    df = spark.createDataFrame(rows, SCHEMA)
    plan = conversations.Repair(df, parts=9)
    got = {r.conv_id: tuple(r)[2:] for r in plan.audits().collect()}
    normal = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got == {c: plain_audit([r for r in normal if r[0] == c]) for c in {r[0] for r in rows}}
    assert plan.stages.spark.read.parquet(f"{plan.stages.base}/002-chunks").where("conv = '=7'").count() > 2
    lines = plan.lines().collect()
    assert sorted((r.conv_id, r.turn is None, r.turn or 0, r.role, r.text) for r in lines) == sorted((c, t is None, t or 0, r, x) for c, t, r, x in normal)


def test_only_one_symbol_for_a_long_time_never_settles_but_ends_right(spark):
    rows = [(1, i, "tool", f"x{i}.") for i in range(3000)] + [(2, i, "user", "same.") for i in range(3000)]
    got = audits_of(conversations.repaired(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA)))
    assert got[1] == plain_audit(rows[:3000]) and got[2] == plain_audit(rows[3000:])
    assert got[2][6].count("D") == 2999


def test_long_text_empty_table_and_all_rows_lost(spark):
    rows = [(1, 0, "user", "w " * 2_000_000 + "."), (1, 1, "assistant", " " * 1_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert audits_of(conversations.repaired(df, df))[1] == plain_audit(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired(none, none).collect() == []
    assert audits_of(conversations.repaired(df, none)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
