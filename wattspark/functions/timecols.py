"""Time arithmetic on TIMESTAMP / TIMESTAMP_NTZ columns.

Telemetry timestamps are wall-clock UTC. Parquet ``timestamp[us]`` without a
zone reads as TIMESTAMP_NTZ; with the session zone fixed to UTC a cast to
TIMESTAMP keeps the instant, which makes ``unix_micros`` usable on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since the epoch (long) of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def epoch_seconds(ts) -> Column:
    """Fractional seconds since the epoch (double)."""
    return epoch_us(ts) / F.lit(1_000_000.0)


def to_ntz(us: Column) -> Column:
    """Epoch microseconds back to a TIMESTAMP_NTZ (UTC wall clock)."""
    return F.timestamp_micros(us).cast("timestamp_ntz")


def bucket_start(ts, seconds: float) -> Column:
    """Epoch-aligned, left-closed bucket start (left label) of width ``seconds``.

    Same buckets as ``window(ts, '<seconds> seconds').start`` and as a
    dynamic group-by with every=period=width, but a plain codegen'd expression
    that also works as a join / grouping key.
    """
    width = int(round(seconds * 1_000_000))
    us = epoch_us(ts)
    return to_ntz(F.floor(us / F.lit(width)).cast("long") * F.lit(width))


def bucket_center(ts, seconds: float) -> Column:
    """Bucket start plus half the width (the centred label used for series)."""
    width = int(round(seconds * 1_000_000))
    us = epoch_us(ts)
    return to_ntz(F.floor(us / F.lit(width)).cast("long") * F.lit(width) + F.lit(width // 2))


def add_seconds(ts, seconds: float) -> Column:
    """``ts + seconds`` keeping the input timestamp flavour (NTZ stays NTZ)."""
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)))


def elapsed_ms(prev, cur) -> Column:
    """Whole milliseconds from ``prev`` to ``cur``, truncated (duration.total_milliseconds)."""
    return F.timestamp_diff("MILLISECOND", _c(prev), _c(cur))


def round_to_second(ts) -> Column:
    """Round to the nearest whole second, halves up."""
    return F.date_trunc("second", add_seconds(ts, 0.5)).cast("timestamp_ntz")


def ensure_utc(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """H6: ``col`` as a UTC wall clock, by its type: text is read as UTC (NULL if it is no time),
    a naive timestamp is UTC already, a zoned one is converted."""
    kind = df.schema[col].dataType.simpleString()
    c = F.col(col)
    if kind == "string":
        c = F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")), F.try_to_timestamp(c)).cast("timestamp_ntz")
    elif kind == "timestamp":
        c = F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))
    return df.withColumn(col, c)
