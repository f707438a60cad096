"""Shards by rendezvous hashing: each record goes to the shard that scores best for its key.

A shard's score for a key is -ln(u) / weight, u an even draw from (0, 1) fixed by key and shard number; the
least score wins. Shards so get records in proportion to their weights, and a record's place depends on its
key and the weights alone. A shard added behind the others, or a heavier one, only takes records to itself; one
taken out (weight 0) only gives its own away. Nothing is counted or remembered between runs.

Inside a shard records lie in the order of a hash of the key. `write_shards` deals them out by sampled ranges
of (shard, that order), so a shard of any size is written by many tasks and a shard's files can each be read
alone; the manifest says where each file's slots begin.

Edge cases: a null key counts as the empty text; null and empty texts are records like others; records of one
key share a shard, and have slots of their own, equal rows too; an empty table gives no files and no rows. Other
columns stay, and names of added ones that are taken get a leading underscore.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.common import partitions_for, unused

#: Records of a task, and so of a file of a shard.
ROWS_EACH = 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that holds `key`; `weights` has one number per shard, 0 for none of the records."""
    if not any(w > 0 for w in weights) or not all(0 <= w < math.inf for w in weights):
        raise ValueError("weights must be finite, none negative, one above 0")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(weight: Column, shard: Column) -> Column:
        # 53 random bits, moved by a half, are never 0 or 1.
        even = (F.shiftrightunsigned(F.xxhash64(text, shard.cast("int")), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        cost = F.when(weight > 0, -F.log(even) / weight).otherwise(F.lit(math.inf))
        return F.struct(cost.alias("cost"), shard.cast("int").alias("shard"))

    return F.array_min(F.transform(F.lit([float(w) for w in weights]), score))["shard"]


@dataclass
class Shards:
    """Written shards: `data`, a row per record, and `manifest`, a row per file part of a shard.

    `names` maps shard, piece and at to the columns that hold them in `data`.
    """

    data: DataFrame
    manifest: DataFrame
    names: dict[str, str]


def write_shards(
    docs: DataFrame, target: str, weights: Sequence[float], key: str = "doc_id", parts: int | None = None
) -> Shards:
    """Write the records below `target`/data/<shard>=n/ and the manifest to `target`/manifest.

    The manifest has shard, piece, first_at, rows and start, the slot of the piece's first record. `docs` must
    come in the same order if it is read again (a table does), since equal records are told apart by place.
    """
    spark = docs.sparkSession
    names = {n: unused(docs, n) for n in ("shard", "spread", "tie", "piece", "at")}
    shard, spread, tie, piece, at = names.values()
    if parts is None:
        parts = partitions_for(spark, docs.count(), ROWS_EACH)
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    # The place in the input splits even a key, or a row, that a third of the table repeats.
    placed = docs.withColumns(
        {shard: rendezvous(F.col(key), weights), spread: F.xxhash64(text), tie: F.monotonically_increasing_id()}
    )
    dealt = (
        placed.repartitionByRange(parts, shard, spread, tie)
        .sortWithinPartitions(shard, spread, tie)
        .drop(spread, tie)
        .withColumns({piece: F.spark_partition_id(), at: F.monotonically_increasing_id()})
    )
    dealt.write.option("compression", "zstd").partitionBy(shard).parquet(f"{target}/data")
    data = spark.read.schema(dealt.schema).parquet(f"{target}/data")
    whole = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counted = data.groupBy(F.col(shard).alias("shard"), F.col(piece).alias("piece")).agg(
        F.min(at).alias("first_at"), F.count(F.lit(1)).alias("rows")
    )
    manifest = counted.withColumn("start", F.coalesce(F.sum("rows").over(whole), F.lit(0)))
    manifest.write.parquet(f"{target}/manifest")
    manifest = spark.read.schema(manifest.schema).parquet(f"{target}/manifest")
    return Shards(data, manifest, {n: names[n] for n in ("shard", "piece", "at")})


def with_slots(shards: Shards, name: str = "slot") -> DataFrame:
    """The records of all shards with their slot, counted from 0 in each shard without gaps."""
    shard, piece, at = shards.names.values()
    slot = unused(shards.data, name)
    starts = shards.manifest.select(
        F.col("shard").alias(shard), F.col("piece").alias(piece), (F.col("start") - F.col("first_at")).alias("_shift")
    )
    # A row per file part: Spark joins it by broadcast as long as it is small.
    return (
        shards.data.join(starts, [shard, piece])
        .withColumn(slot, F.col(at) + F.col("_shift"))
        .drop("_shift", piece, at)
    )
