"""Typed tables on Parquet, and views of the provided test tables as readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Write `df`, replacing exactly the partitions it holds: running twice leaves the same rows."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )


def read_fold(spark: SparkSession, path: str, case: str, round_: int, fold: int) -> DataFrame:
    """One fold set; `case` and `round` prune partitions, `fold` reaches the scan as a filter."""
    table = spark.read.parquet(path)
    return table.where(
        (F.col("case") == case) & (F.col("round") == round_) & (F.col("fold") == fold)
    )


def lineitem_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as five-variable recordings, one per (class, supplier)."""
    flag = F.col("l_returnflag")
    status = F.col("l_linestatus")
    kind = F.when(flag == "A", 0).when(flag == "N", 2).when(flag == "R", 4)
    shift = F.when(status == "F", 0).when(status == "O", 1)
    return spark.read.parquet(f"{folder}/lineitem.parquet").select(
        (kind + shift).alias("class_id"),
        F.col("l_suppkey").alias("instance_id"),
        (F.col("l_suppkey") % 10).cast("int").alias("well_id"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("seq"),
        F.col("l_quantity").alias("v1"),
        (F.col("l_extendedprice") / 1000).alias("v2"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("v3"),
        F.col("l_tax").alias("v4"),
        F.col("l_linenumber").cast("double").alias("v5"),
    )


def event_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Events as one-variable recordings, one per user."""
    return spark.read.parquet(f"{folder}/events.parquet").select(
        F.lit(0).alias("class_id"),
        F.col("user_id").alias("instance_id"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("v1"),
    )
