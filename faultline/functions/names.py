"""Scalar expressions on recording and experiment names, time stamps and class codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def well_key(name: Column) -> Column:
    """First ten characters, `WELL-00001`."""
    return F.substring(name, 1, 10)


def well_number(name: Column) -> Column:
    """Digits 7 to 10 of the recording name as a number."""
    return F.substring(name, 7, 4).cast("int")


def is_real(name: Column) -> Column:
    """Real recordings carry names starting with W; simulated and drawn ones do not."""
    return F.startswith(name, F.lit("W"))


def experiment_stem(x: Column) -> Column:
    return F.substring(x, F.lit(1), F.length(x) - 1)


def experiment_case(x: Column) -> Column:
    return F.right(x, F.lit(1))


def experiment_group(x: Column) -> Column:
    """The one character before the last."""
    return F.substring(x, -2, 1)


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of a time stamp text without a zone, read as UTC."""
    return F.to_timestamp(F.concat(text, F.lit("Z"))).cast("double")


def session_stamp(ts: Column) -> Column:
    """`yyyyMMddHHmmss` as a whole number."""
    return F.date_format(ts, "yyyyMMddHHmmss").cast("bigint")


def one_hot(x: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == x).cast("int"))


def one_hot_inverse(a: Column) -> Column:
    """Index of the first largest entry."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
