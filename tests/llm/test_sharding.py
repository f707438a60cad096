"""Rendezvous shards against a plain version, their slots, and what moves when shards change."""

import math
import uuid
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from faultline.llm import queries, sharding
from faultline.llm.common import folder_for


def plain_shard(key, weights):
    """Spark's xxhash64(text, int) is XXH64 of the int, seeded with XXH64 of the text, seeded with 42."""
    seed = xxhash.xxh64_intdigest(("" if key is None else str(key)).encode(), 42)
    best = None
    for shard, weight in enumerate(weights):
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed)
        cost = -math.log(((h >> 11) + 0.5) * 2.0**-53) / weight if weight else math.inf
        best = min(best or (math.inf, math.inf), (cost, shard))
    return best[1]


def shards_of(spark, keys, weights):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    return {r.k: r.s for r in df.select("k", sharding.rendezvous(F.col("k"), weights).alias("s")).collect()}


def test_query_against_the_plain_version(spark, folder, rows_of):
    got = queries.QUERIES["op13_sharding"](spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows_of)
    slots = defaultdict(list)
    for r in got:
        data = (rows_of[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.shard == plain_shard(r.doc_id, [1] * 40)
        assert r.grown_shard == plain_shard(r.doc_id, [1] * 41)
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert dict(queries.QUERIES["op13_sharding"](spark, folder).dtypes) == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int",
    }


def test_weights_give_shares_and_only_the_changed_shard_trades_records(spark):
    keys = [f"k{i}" for i in range(20_000)]
    weights = [1, 2, 0, 4.5]
    before = shards_of(spark, keys, weights)
    assert all(before[k] == plain_shard(k, weights) for k in keys[:500])
    share = Counter(before.values())
    for shard, weight in enumerate(weights):
        assert abs(share[shard] / len(keys) - weight / 7.5) < 0.015
    heavier = shards_of(spark, keys, [1, 3, 0, 4.5])
    assert {(before[k], heavier[k]) for k in keys if before[k] != heavier[k]} == {(0, 1), (3, 1)}
    gone = shards_of(spark, keys, [1, 0, 0, 4.5])
    assert {before[k] for k in keys if before[k] != gone[k]} == {1}
    grown = shards_of(spark, keys, [*weights, 2.5])
    moved = [k for k in keys if before[k] != grown[k]]
    assert {grown[k] for k in moved} == {4} and abs(len(moved) / len(keys) - 0.25) < 0.015


def write(docs, weights, **more):
    return sharding.write_shards(docs, folder_for(docs.sparkSession, "shards"), weights, **more)


def test_one_id_in_a_third_of_the_rows_is_dealt_over_pieces_and_keeps_gapless_slots(make_docs):
    rows = [(7, f"text {i % 50}") for i in range(600)] + [(None, None)] * 300 + [(i, "é" * i) for i in range(100, 400)]
    shards = write(make_docs(rows), [1, 1, 1], parts=7)
    placed = sharding.with_slots(shards).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter(rows)
    per_shard = defaultdict(list)
    for r in placed:
        per_shard[r.shard].append((r.slot, r.doc_id))
    for found in per_shard.values():
        assert sorted(s for s, _ in found) == list(range(len(found)))
        # Records lie in the order of a hash of their key: those of one key together.
        ids = [i for _, i in sorted(found, key=lambda f: f[0])]
        assert len([1 for a, b in zip(ids, ids[1:]) if a != b]) == len(set(ids)) - 1
    assert len({r.shard for r in placed if r.doc_id == 7}) == 1
    pieces = shards.manifest.collect()
    hot = next(r.shard for r in placed if r.doc_id == 7)
    assert len([p for p in pieces if p.shard == hot]) >= 4
    assert max(p.rows for p in pieces) <= 400


def test_taken_names_long_texts_empty_table_and_bad_weights(spark, make_docs):
    docs = make_docs([(1, "w " * 500_000), (2, ""), (3, None)])
    docs = docs.withColumns({"shard": F.lit("mine"), "SLOT": F.lit(5), "piece": F.lit(2), "at": F.lit(1)})
    placed = sharding.with_slots(write(docs, [1, 1]))
    assert set(docs.columns) < set(placed.columns) and {"_shard", "_slot"} < set(placed.columns)
    assert {(r.doc_id, r.shard, len(r.text or "")) for r in placed.collect()} == {(1, "mine", 1_000_000), (2, "mine", 0), (3, "mine", 0)}
    assert sharding.with_slots(write(make_docs([]), [1, 1])).collect() == []
    for weights in ([], [0, 0], [1, -1], [1, math.inf], [1, math.nan]):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.lit("x"), weights)


def test_place_depends_on_the_key_alone(spark, make_docs):
    a = {r.doc_id: r.shard for r in sharding.with_slots(write(make_docs([(i, "x") for i in range(50)]), [1] * 5)).collect()}
    b = {r.doc_id: r.shard for r in sharding.with_slots(write(make_docs([(i, str(uuid.uuid4())) for i in range(49, -1, -2)]), [1] * 5)).collect()}
    assert all(a[i] == s for i, s in b.items())
