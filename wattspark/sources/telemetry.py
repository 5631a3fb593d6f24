"""Parquet telemetry scans.

Two lake layouts are read:

* flat day files ``<table>/<table>_<start>_<end>.parquet`` (the extract layout),
  pruned on the dates in the file name through ``_metadata.file_name``;
* hive day partitions ``<table>/timestamp_day=YYYY-MM-DD/`` (the load layout),
  pruned by a ``timestamp_day`` predicate derived from the time filter.

Column selection and time predicates are plain DataFrame operations, so
Catalyst pushes them into the Parquet scan (``ReadSchema`` / ``PushedFilters``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FILE_RANGE = r"_(\d{4}-\d{2}-\d{2}(?:T[0-9:.]+)?)_(\d{4}-\d{2}-\d{2}(?:T[0-9:.]+)?)\.parquet$"


def _lit_ts(v) -> F.Column:
    if isinstance(v, F.Column):
        return v
    if isinstance(v, str):
        v = dt.datetime.fromisoformat(v)
    return F.lit(v).cast("timestamp_ntz")


def empty_frame(spark: SparkSession, schema: StructType | None = None) -> DataFrame:
    return spark.createDataFrame([], schema or StructType([]))


def telemetry_scan(spark: SparkSession, path: str, *, timefilter: tuple | None = None,
                   columns: Sequence[str] | None = None, ts_col: str = "timestamp",
                   schema: StructType | None = None, tolerant: bool = False,
                   prune_file_names: bool = True) -> DataFrame:
    """A1-A4: union of every parquet file under ``path``; empty frame if there are none.

    ``timefilter=(tmin, tmax)`` keeps files whose name range overlaps it (A2) and
    rows with ``tmin <= ts <= tmax`` (C1, closed). A file that can't be read fails the
    scan, unless ``tolerant`` (A4): then it is skipped, as are files that lack one of
    the requested ``columns``; :func:`skipped_files` reports both.
    """
    r = spark.read
    if tolerant:
        r = r.option("ignoreCorruptFiles", "true")
    if schema is not None:
        r = r.schema(schema)
    try:
        df = r.option("recursiveFileLookup", "false").parquet(path)
    except Exception as e:  # noqa: BLE001 - no files / unreadable directory
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            return empty_frame(spark, schema)
        raise
    if timefilter is not None:
        lo, hi = _lit_ts(timefilter[0]), _lit_ts(timefilter[1])
        if "timestamp_day" in df.columns:
            df = df.where((F.col("timestamp_day") >= F.to_date(lo)) & (F.col("timestamp_day") <= F.to_date(hi)))
        elif prune_file_names:
            name = F.col("_metadata.file_name")
            f_lo = F.try_to_timestamp(F.regexp_extract(name, FILE_RANGE, 1))
            f_hi = F.try_to_timestamp(F.regexp_extract(name, FILE_RANGE, 2))
            named = F.regexp_extract(name, FILE_RANGE, 1) != ""
            df = df.where(~named | ((f_lo.cast("timestamp_ntz") <= hi) & (f_hi.cast("timestamp_ntz") >= lo)))
        df = df.where(F.col(ts_col).between(lo, hi))
    if tolerant and columns:
        bad = skipped_files(spark, path, schema, columns).where(F.col("reason") != UNREADABLE).select(F.col("file").alias("__bad"))
        df = df.withColumn("__file", F.col("_metadata.file_path")).join(bad, F.col("__file") == F.col("__bad"), "left_anti")
    if columns:
        df = select_existing(df, columns)
    return df


UNREADABLE = "unreadable or empty"


def skipped_files(spark: SparkSession, path: str, schema: StructType | None = None,
                  columns: Sequence[str] = ()) -> DataFrame:
    """A4: ``file, reason`` of what a tolerant scan of ``path`` leaves out: files without a readable row, and files
    that lack one of ``columns`` (one row per file, first such column). A column that a file has counts as there, also if it
    holds nothing but nulls: only files without a value of a column have their footers looked at.
    """
    from wattspark.sources.lake import footers
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))  # listing only
    r = spark.read.option("ignoreCorruptFiles", "true")
    df = (r.schema(schema) if schema is not None else r).parquet(path)
    have = [c for c in columns if c in df.columns]
    read = df.select(F.col("_metadata.file_path").alias("file"), *[F.col(c) for c in have])
    seen = read.groupBy("file").agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(have)] or [F.count(F.lit(1)).alias("n")])
    bare = F.lit(len(have) < len(columns))
    for i in range(len(have)):
        bare = bare | (F.col(f"n_{i}") == 0)
    names = footers(seen.where(bare).select("file")).select(F.col("file").alias("__of"), "names")
    seen = seen.select("file", F.lit(True).alias("__read")).join(names, F.col("file") == F.col("__of"), "left")
    why = F.coalesce(*[F.when(~F.array_contains("names", c), F.lit(f"no value of {c}")) for c in columns], F.lit(None).cast("string"))
    known = seen.select("file", "__read", why.alias("__why"))
    return (files.join(known, "file", "left")
            .select("file", F.when(F.col("__read").isNull(), F.lit(UNREADABLE)).otherwise(F.col("__why")).alias("reason"))
            .where(F.col("reason").isNotNull()))


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A3: project ``columns``; a column absent from the files is a NULL column."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def range_half_open(df: DataFrame, start, end, ts_col: str = "timestamp") -> DataFrame:
    """``start <= ts < end``; on a day-partitioned table also a partition predicate."""
    lo, hi = _lit_ts(start), _lit_ts(end)
    if "timestamp_day" in df.columns:
        df = df.where((F.col("timestamp_day") >= F.to_date(lo)) & (F.col("timestamp_day") <= F.to_date(hi)))
    return df.where((F.col(ts_col) >= lo) & (F.col(ts_col) < hi))


def experiment_scan(df: DataFrame, job_ids, col: str = "SLURM_JOB_ID") -> DataFrame:
    """A5: experiments of one job id or a list of ids."""
    ids = [job_ids] if isinstance(job_ids, (str, int)) else list(job_ids)
    return df.where(F.col(col).isin([str(i) for i in ids]))


def day_sliced_extract(df: DataFrame, out_path: str, start, end, columns: Sequence[str],
                       ts_col: str = "timestamp", mode: str = "overwrite") -> None:
    """The days in [start, end), fixed projection, half-open predicate, one
    output folder per day - written by ONE job (``partitionBy('day')``)."""
    from wattspark.sources.lake import clustered_by_time
    d = range_half_open(df, start, end, ts_col).select(*columns).withColumn("day", F.to_date(ts_col))
    clustered_by_time(d, "day", ts_col).write.mode(mode).partitionBy("day").parquet(out_path)
