"""Session defaults and the stage boundary."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", name: str = "faultline", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    folder = tempfile.mkdtemp(prefix="faultline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    settings = {
        "spark.checkpoint.dir": folder,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` or the context names it.

    A session on a single machine that names none gets a temporary one; on a cluster executors would
    write to their own disks there, so it must be named.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="faultline-"))
        folder = context.getCheckpointDir()
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder name below the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that nothing refers to any more: it finds them when the driver's JVM
    collects garbage, which by itself may not happen within a run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def open_shared(path: str):
    """A file of the shared folder, inside a task, whatever its scheme."""
    from pyarrow import fs

    # Hadoop prints local paths as file:/x, and has names of its own for S3.
    uri = re.sub("^file:/+", "file:///", re.sub("^s3[an]://", "s3://", path))
    where, name = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return where.open_input_file(name)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Cuts lineage like a checkpoint, but stays columnar: readers of the stage prune columns and
    push filters, and lost executors cost a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
