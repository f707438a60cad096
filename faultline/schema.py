"""Column names and constants shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of a raw recording, by position.
RAW_TIME = "timestamp"
RAW_VARIABLES = [
    "P-PDG",
    "P-TPT",
    "T-TPT",
    "P-MON-CKP",
    "T-JUS-CKP",
    "P-JUS-CKGL",
    "T-JUS-CKGL",
    "QGL",
]
RAW_CLASS = "class"

# Class directories, the five variables in use, wells held out in turn.
CLASSES = [0, 1, 2, 3, 4, 5, 6, 7, 8]
USED_VARIABLES = [1, 2, 3, 4, 5]
TEST_WELLS = [1, 2, 4, 5, 7]

FLOAT32_MAX = 3.4028234663852886e38

RECORDING = ["class_id", "instance_id"]
WINDOW = RECORDING + ["w"]
VARIABLES = [f"v{i}" for i in USED_VARIABLES]

RAW_SCHEMA = T.StructType(
    [T.StructField(RAW_TIME, T.TimestampType())]
    + [T.StructField(v, T.DoubleType()) for v in RAW_VARIABLES]
    + [T.StructField(RAW_CLASS, T.DoubleType())]
)
