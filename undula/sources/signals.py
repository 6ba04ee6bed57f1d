"""Reading a long table as signals, and checking it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NO_NUMBER = (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
_NO_ID = (*_NO_NUMBER,)


def _number(df: DataFrame, name: str) -> Column:
    return F.expr(f"try_cast(`{name}` AS double)")


def profile(df: DataFrame, signal_id: str = "signal_id", timestamp: str = "timestamp", value_col: str = "value") -> DataFrame:
    """One row: rows, signals, null ids, and times and values that are null, NaN, infinite or no number."""
    bad = lambda c: F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(signal_id).alias("n_signals"), F.count_if(F.col(signal_id).isNull()).alias("null_ids"), bad(_number(df, timestamp)).alias("bad_times"), bad(_number(df, value_col)).alias("bad_values"))


def validate(df: DataFrame, signal_id: str = "signal_id", timestamp: str = "timestamp", value_col: str = "value") -> DataFrame:
    """The table as (signal_id, timestamp, value) with double times and values; raises if it can't be used.

    TypeError: not a DataFrame.  ValueError: a column is missing or of an unusable type, the table is
    empty, an id is null, or a time or value is null, NaN, infinite or no number.  Further columns are
    left out.  The caller's table stays as it is.
    """
    if not isinstance(df, DataFrame):
        raise TypeError("signals must be a Spark DataFrame")
    missing = {signal_id, timestamp, value_col} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    for name, refused in ((signal_id, _NO_ID), (timestamp, _NO_NUMBER), (value_col, _NO_NUMBER)):
        if isinstance(df.schema[name].dataType, refused):
            raise ValueError(f"column {name} has type {df.schema[name].dataType.simpleString()}")
    seen = profile(df, signal_id, timestamp, value_col).first()
    if seen.n_rows == 0 or seen.n_signals == 0:
        raise ValueError("there are no signals")
    if seen.null_ids or seen.bad_times or seen.bad_values:
        raise ValueError(f"{seen.null_ids} null ids, {seen.bad_times} unusable times, {seen.bad_values} unusable values")
    return df.select(F.col(signal_id).alias("signal_id"), _number(df, timestamp).alias("timestamp"), _number(df, value_col).alias("value"))


def from_events(events: DataFrame) -> DataFrame:
    """`events` as signals: one for each user, times in seconds."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return events.select(F.col("user_id").alias("signal_id"), seconds.alias("timestamp"), F.col("value").cast("double").alias("value"))


def lengths(signals: DataFrame) -> DataFrame:
    """(signal_id, n)."""
    return signals.groupBy("signal_id").agg(F.count("*").alias("n"))


def shortest(signals: DataFrame) -> int:
    """Points of the shortest signal."""
    return lengths(signals).agg(F.min("n")).first()[0]


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by keys to as many tasks as the session has for a shuffle.

    For grouped kernels: they take long over few bytes, which Spark would otherwise put into few tasks.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def packed(signals: DataFrame) -> DataFrame:
    """(signal_id, values): one row for each signal, its values in order of time, then value, nulls last."""
    place = [f(c) for c in ("timestamp", "value") for f in (lambda c: F.col(c).isNull().alias(f"no_{c}"), F.col)]
    points = dealt(signals.select("signal_id", "timestamp", "value"), "signal_id").groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct(*place))).alias("points"))
    return points.select("signal_id", F.col("points.value").cast("array<double>").alias("values"))


def alike(values: pa.ListArray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for signals of one length at a time: their places in `values`, and a table (points, signals).

    A table has at most `cells` cells, or one signal.  Null values are NaN.
    """
    ends = values.offsets.to_numpy()
    flat, sizes = values.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        some = max(1, cells // max(int(n), 1))
        for i in range(0, len(rows), some):
            yield rows[i : i + some], flat[np.arange(n)[:, None] + ends[rows[i : i + some]]]
