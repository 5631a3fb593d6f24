"""Data-quality profile of telemetry tables.

Quantiles are exact and computed from a value histogram (one row per distinct
value), never by collecting a group's values into one buffer: the histogram is
built by a distributed group-by, and its size is bounded by the number of
distinct values (per-second counts, or microsecond offsets below 500 000).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattspark.functions.timecols import bucket_start, epoch_us, round_to_second


def per_second_counts(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """rows per non-empty 1 s window -> (second, count)."""
    return df.groupBy(bucket_start(ts_col, 1).alias("second")).agg(F.count(F.lit(1)).alias("count"))


def with_round_delta(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """``delta_us`` = |ts - ts rounded to the nearest second (halves up)|, NULL rows dropped."""
    d = df.where(F.col(ts_col).isNotNull())
    return d.withColumn("delta_us", F.abs(epoch_us(ts_col) - epoch_us(round_to_second(ts_col))))


def value_histogram(df: DataFrame, col: str, count_col: str = "count") -> DataFrame:
    """Count per distinct value (sorting is left to the consumer)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(count_col))


#: slices of the value range for running counts
SLICES = 1000


def hist_quantiles(hist: DataFrame, col: str, qs: dict[str, float], count_col: str = "count") -> DataFrame:
    """Exact quantiles from a histogram, one row.

    ``nearest`` rule: index round(q * (n - 1)) of the sorted values; the key
    ``median`` is interpolated (mean of the two middle values). Running counts have two
    levels: the value range is cut into ``SLICES`` equal slices, each with a window of its own,
    and a window over the slices' totals (at most ``SLICES`` + 1 rows) gives what is before a slice.
    """
    lo, hi = hist.select(F.min(col).cast("double")).scalar(), hist.select(F.max(col).cast("double")).scalar()
    part = F.floor(F.coalesce(F.try_divide(F.col(col) - lo, hi - lo), F.lit(0.0)) * SLICES)
    h = hist.select(col, count_col, part.alias("__s"))
    totals = h.groupBy("__s").agg(F.sum(count_col).alias("__t"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = totals.select("__s", F.sum("__t").over(every).alias("__n"),
                           (F.sum("__t").over(Window.orderBy("__s")) - F.col("__t")).alias("__before"))
    w = Window.partitionBy("__s").orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = h.withColumn("__in", F.sum(count_col).over(w)).join(before, "__s")
    n, cum = F.col("__n"), F.col("__before") + F.col("__in")
    aggs = []
    for name, q in qs.items():
        if name == "median":
            lo = F.floor((n - 1) / F.lit(2.0))
            hi = F.ceil((n - 1) / F.lit(2.0))
            a = F.min(F.when(cum > lo, F.col(col)))
            b = F.min(F.when(cum > hi, F.col(col)))
            aggs.append(((a + b) / F.lit(2.0)).alias(name))
        else:
            idx = F.round((n - 1) * F.lit(float(q)))
            aggs.append(F.min(F.when(cum > idx, F.col(col))).cast("double").alias(name))
    return h.agg(*aggs)


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Columns of one-row frames in one row, without a join or a driver round trip.

    The frames are stacked (each NULL in the others' columns) and one global
    aggregate takes, per column, the single row that carries it.
    """
    cols = [c for f in frames for c in f.columns]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def distribution_summary(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Mean, median, q25, q75, min, max, sample std of ``col`` (one row)."""
    base = df.agg(F.avg(col).alias(prefix + "mean"), F.min(col).cast("double").alias(prefix + "min"),
                  F.max(col).cast("double").alias(prefix + "max"),
                  F.stddev_samp(col).alias(prefix + "std"))
    q = hist_quantiles(value_histogram(df.where(F.col(col).isNotNull()), col, "__freq"),
                       col, {"median": 0.5, "q25": 0.25, "q75": 0.75}, count_col="__freq")
    q = q.select(*[F.col(c).alias(prefix + c) for c in q.columns])
    return side_by_side(base, q)


def table_quality_profile(tables: dict[str, DataFrame], ts_col: str = "timestamp") -> DataFrame:
    """I16: one row per table: rows, per-second count stats (``cnt_*``) and
    sub-second offset stats in microseconds (``delta_*``)."""
    out = None
    for name, df in tables.items():
        t = df.select(F.col(ts_col).alias("timestamp"))
        cnt = distribution_summary(per_second_counts(t, "timestamp"), "count", "cnt_")
        dlt = distribution_summary(with_round_delta(t, "timestamp"), "delta_us", "delta_")
        rows = t.agg(F.count(F.lit(1)).alias("rows"))
        row = side_by_side(rows, cnt, dlt).select(F.lit(name).alias("table"), "rows", *cnt.columns,
                                                   *dlt.columns)
        out = row if out is None else out.unionByName(row)
    return out


def quality_histogram(tables: dict[str, DataFrame], ts_col: str = "timestamp") -> DataFrame:
    """I16: the histogram of rows per second of each table: ``table, count, seconds``."""
    out = None
    for name, df in tables.items():
        h = value_histogram(per_second_counts(df.select(F.col(ts_col).alias("timestamp"))), "count", "seconds")
        h = h.select(F.lit(name).alias("table"), "count", "seconds")
        out = h if out is None else out.unionByName(h)
    return out
