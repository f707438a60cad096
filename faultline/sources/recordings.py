"""Raw recordings: a tree of CSV files, one folder per class, one file per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from faultline.functions import names
from faultline.operators.clean import nan_to_null
from faultline.schema import CLASSES, RAW_SCHEMA, RAW_TIME, RAW_VARIABLES


def scan_csv(spark: SparkSession, root: str, include_simulated: bool = False) -> DataFrame:
    """`<root>/<class>/<recording>.csv` as readings.

    The header line is skipped and columns go by position. Real recordings are picked by the file
    glob, so simulated files are never opened. Class, recording and well come from the file path.
    """
    glob = "*.csv" if include_simulated else "*WELL*.csv"
    folders = "{" + ",".join(str(c) for c in CLASSES) + "}"
    raw = (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("timeZone", "UTC")
        .option("pathGlobFilter", glob)
        .csv(f"{root}/{folders}")
    )
    path = F.col("_metadata.file_path")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    variables = [f"v{i + 1}" for i in range(len(RAW_VARIABLES))]
    typed = raw.select(
        F.regexp_extract(path, r"/(\d)/[^/]+$", 1).cast("int").alias("class_id"),
        name.alias("instance_id"),
        F.regexp_extract(name, r"^WELL-(\d+)", 1).try_cast("int").alias("well_id"),
        F.col(RAW_TIME).alias("ts"),
        F.struct(*(F.col(f"`{v}`") for v in RAW_VARIABLES)).alias("seq"),
        *(F.col(f"`{v}`").alias(n) for v, n in zip(RAW_VARIABLES, variables)),
        F.col("class").alias("row_class"),
    )
    return nan_to_null(typed, variables)


def real_recordings(df: DataFrame, name: str = "instance_id") -> DataFrame:
    return df.where(names.is_real(F.col(name)))
