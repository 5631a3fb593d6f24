"""Ordered-series operators that stay parallel on skewed or key-less series.

A plain ``lag`` over ``Window.partitionBy(host).orderBy(ts)`` sends every row
of a host to one task; a key-less series goes to a single task. Here the
order is split into fixed time *chunks*: the window runs per (keys, chunk),
and the first row of each chunk takes its predecessor from the last row of
the previous non-empty chunk (one summary row per chunk, so that side stays
small). The largest task then holds one chunk of one key.

Where bursts may be denser than any fixed width, ``chunk_seconds=DEPTH`` cuts the order into parts of equal
*depth* instead: Spark range-partitions the rows by (keys, time, tie-break) with bounds from a sample, and the last
row of each part is carried into the next. A million samples of one second then spread over tasks like any others.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattspark.functions.timecols import epoch_us, bucket_start
from wattspark.session import scratch_path

DEFAULT_CHUNK_S = 3600
#: a series without keys holds all rows of a stretch of time, so its chunks are shorter
KEYLESS_CHUNK_S = 60
#: ``chunk_seconds`` of this value: parts of equal numbers of rows
DEPTH = "depth"


def _cols(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def _key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` treating NULL keys as equal (series keys may be NULL)."""
    if not keys:
        raise ValueError("a key join needs at least one key")
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def _surrogate_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for series keys: (coalesce(k, default), k IS NULL) per key.

    Window partitioning and the carry join then use the same plain-equality
    columns, so the join reuses the window's hash partitioning and sort order
    (a null-safe join would re-shuffle the large side) and NULL keys still
    form one series.
    """
    cols = []
    for i, k in enumerate(keys):
        dtype = df.schema[k].dataType.simpleString()
        default = {"string": F.lit("")}.get(dtype, F.lit(0).cast(dtype))
        df = df.withColumn(f"__k{i}", F.coalesce(F.col(k), default)).withColumn(f"__n{i}", F.col(k).isNull())
        cols += [f"__k{i}", f"__n{i}"]
    return df, cols


def _order_key(df: DataFrame, ts_col: str, tiebreak: Sequence[str]) -> Column:
    """One value that orders as (ts, tiebreak) with NULLs first; of fixed width, so that an
    aggregate by it can hash, for at most one whole-number tie-break."""
    t = F.coalesce(epoch_us(ts_col), F.lit(-(10 ** 18)))
    if not tiebreak:
        return t
    if len(tiebreak) == 1 and df.schema[tiebreak[0]].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        tie = F.coalesce(F.col(tiebreak[0]).cast("long"), F.lit(-(2 ** 63)))
        return t.cast("decimal(19,0)") * F.lit(str(10 ** 19)).cast("decimal(20,0)") + tie.cast("decimal(19,0)")
    return F.struct(*[F.col(c) for c in [ts_col, *tiebreak]])


def chunked_lag(df: DataFrame, keys, ts_col: str, cols, *, tiebreak=(),
                chunk_seconds: float | str | None = None, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` = value of ``c`` on the previous row of the same series.

    Series = ``keys`` (may be empty), ordered by ``ts_col`` then ``tiebreak``.
    Equal to ``lag(c) over (partition by keys order by ts, tiebreak)``.

    Plan: one exchange on (keys, chunk) feeds one window (running frames only)
    computing the in-chunk lag and the row number, and a hash aggregate that takes each
    chunk's last values. Both read the same exchange: the aggregate uses every column, so that
    column pruning leaves the two sides equal and Spark scans and shuffles the rows once. A small window
    over those one-row-per-chunk summaries finds the previous non-empty chunk, and an
    equi-join on (keys, chunk) - co-partitioned with the large side - brings
    the carry in. The rows are sorted once.
    """
    if chunk_seconds == DEPTH:
        return depth_lag(df, keys, ts_col, cols, tiebreak=tiebreak, prefix=prefix)
    keys, cols, tiebreak = _cols(keys), _cols(cols), _cols(tiebreak)
    order_cols = [ts_col] + tiebreak
    ck = "__chunk"
    width = int((chunk_seconds or (DEFAULT_CHUNK_S if keys else KEYLESS_CHUNK_S)) * 1_000_000)
    d, sk = _surrogate_keys(df, keys)
    d = d.withColumn(ck, F.floor(epoch_us(ts_col) / F.lit(width)).cast("long")).repartition(*sk, ck)
    lasts = d.groupBy(*sk, ck).agg(*[F.max_by(F.col(c), _order_key(d, ts_col, tiebreak)).alias("__last_" + c) for c in cols],
                                   *[F.count(c).alias(f"__used_{i}") for i, c in enumerate(df.columns)])
    used = [F.col(f"__used_{i}") for i in range(len(df.columns))]
    lasts = lasts.where(F.greatest(*used, F.lit(0), F.lit(0)) >= 0)  # always true; keeps the counts
    wc = Window.partitionBy(*sk).orderBy(ck)
    carry = lasts.select(*sk, ck, *[F.lag("__last_" + c).over(wc).alias("__carry_" + c) for c in cols])
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    w = Window.partitionBy(*sk, ck).orderBy(*order)
    d = d.withColumn("__rn", F.row_number().over(w))
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    d = d.join(carry, sk + [ck], "left")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("__rn") == 1, F.col("__carry_" + c))
                         .otherwise(F.col(prefix + c)))
    return d.drop(*["__carry_" + c for c in cols], "__rn", ck, *sk)


def depth_lag(df: DataFrame, keys, ts_col: str, cols, *, tiebreak=(), prefix: str = "prev_", parts: int | None = None) -> DataFrame:
    """The same as :func:`chunked_lag`, in parts of equal depth (``parts`` of them, or as many as Spark shuffles to).

    Rows are range-partitioned and sorted once, numbered (partition in the upper bits) and written to the shared
    checkpoint folder, so that a lost task finds the same parts again. Windows run over (part, keys); the carry is a
    record per part and key. Rows that are equal in keys, time and tie-break are dealt by a last, arbitrary number.
    """
    keys, cols, tiebreak = _cols(keys), _cols(cols), _cols(tiebreak)
    d, sk = _surrogate_keys(df, keys)
    order = [F.col(c).asc_nulls_first() for c in [*sk, ts_col, *tiebreak, "__tie"]]
    d = d.withColumn("__tie", F.monotonically_increasing_id())
    d = (d.repartitionByRange(parts, *order) if parts else d.repartitionByRange(*order)).sortWithinPartitions(*order)
    d = d.drop("__tie").withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33))
    path = scratch_path(df.sparkSession, f"wattspark/depth-{uuid.uuid4().hex[:12]}")
    d.write.parquet(path)
    d = df.sparkSession.read.schema(d.schema).parquet(path)
    lasts = d.groupBy(*sk, "__part").agg(*[F.max_by(F.struct(*cols), F.col("__at")).alias("__last")])
    carry = lasts.select(*sk, "__part", F.lag("__last").over(Window.partitionBy(*sk).orderBy("__part")).alias("__carry"))
    w = Window.partitionBy("__part", *sk).orderBy("__at")
    d = d.withColumn("__rn", F.row_number().over(w))
    for c in cols:
        d = d.withColumn(prefix + c, F.lag(c).over(w))
    d = d.join(carry, [*sk, "__part"], "left")
    for c in cols:
        d = d.withColumn(prefix + c, F.when(F.col("__rn") == 1, F.col("__carry")[c]).otherwise(F.col(prefix + c)))
    return d.select(*df.columns, *[prefix + c for c in cols])


def diff_over(df: DataFrame, keys, ts_col: str, cols, *, tiebreak=(), clip_at_zero=True,
              fill_first=0, suffix: str = "_rate", chunk_seconds: float | None = None) -> DataFrame:
    """``c - lag(c)`` per series (F7/F8); optionally clipped at 0 and first row filled.

    Matches ``diff().clip(lower_bound=0).fill_null(0)``: a counter reset gives 0.
    """
    cols = _cols(cols)
    d = chunked_lag(df, keys, ts_col, cols, tiebreak=tiebreak, chunk_seconds=chunk_seconds,
                    prefix="__p_")
    for c in cols:
        v = F.col(c) - F.col("__p_" + c)
        if clip_at_zero:
            v = F.when(v.isNull(), v).otherwise(F.greatest(v, F.lit(0)))
        if fill_first is not None:
            v = F.coalesce(v, F.lit(fill_first))
        d = d.withColumn(c + suffix, v)
    return d.drop(*["__p_" + c for c in cols])


def elapsed_between_rows(df: DataFrame, keys, ts_col: str, *, tiebreak=(),
                         chunk_seconds: float | None = None) -> DataFrame:
    """``dt_ms`` = whole ms since the previous row of the series (NULL for the first)."""
    d = chunked_lag(df, keys, ts_col, [ts_col], tiebreak=tiebreak,
                    chunk_seconds=chunk_seconds, prefix="__prev_")
    return d.withColumn("dt_ms", F.timestamp_diff("MILLISECOND", F.col("__prev_" + ts_col),
                                                 F.col(ts_col))).drop("__prev_" + ts_col)


def chunked_row_number(df: DataFrame, keys, ts_col: str, *, tiebreak=(),
                       chunk_seconds: float = 86400, name: str = "row_idx",
                       zero_based: bool = True) -> DataFrame:
    """row index after sorting each series, computed without a one-task window.

    Index = row number inside (keys, chunk) + number of rows of the earlier
    chunks of the same series (running sum over one count row per chunk).
    """
    keys, tiebreak = _cols(keys), _cols(tiebreak)
    ck = "__chunk"
    width = int(chunk_seconds * 1_000_000)
    d, sk = _surrogate_keys(df, keys)
    d = d.withColumn(ck, F.floor(epoch_us(ts_col) / F.lit(width)).cast("long"))
    w = Window.partitionBy(*sk, ck).orderBy(*[F.col(c).asc_nulls_first() for c in [ts_col] + tiebreak])
    d = d.withColumn("__rn", F.row_number().over(w))
    counts = d.groupBy(*sk, ck).agg(F.count(F.lit(1)).alias("__n"))
    wc = Window.partitionBy(*sk).orderBy(ck).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*sk, ck, F.coalesce(F.sum("__n").over(wc), F.lit(0)).alias("__off"))
    d = d.join(offs, sk + [ck], "left")
    idx = F.col("__rn") + F.col("__off") - (1 if zero_based else 0)
    return d.withColumn(name, idx.cast("long")).drop("__rn", "__off", ck, *sk)


def tumbling_agg(df: DataFrame, ts_col: str, seconds: float, keys, aggs: Sequence[Column],
                 *, label: str = "timestamp", center: bool = False) -> DataFrame:
    """epoch-aligned tumbling windows, left-closed, left label, empty windows omitted.

    ``center=True`` labels each bucket by its midpoint (start + width/2).
    """
    keys = _cols(keys)
    b = bucket_start(ts_col, seconds)
    out = df.groupBy(b.alias(label), *keys).agg(*aggs)
    if center:
        half_us = int(seconds * 1_000_000) // 2
        out = out.withColumn(label, F.timestamp_micros(
            epoch_us(label) + F.lit(half_us)).cast("timestamp_ntz"))
    return out


def trim_ends(df: DataFrame, ts_col: str, keys=()) -> DataFrame:
    """Drop the first and the last bucket of each series (partial windows)."""
    keys = _cols(keys)
    bounds = df.groupBy(*keys).agg(F.min(ts_col).alias("__lo"), F.max(ts_col).alias("__hi"))
    if not keys:
        # one series: the bounds are two scalar sub-queries, no join at all
        lo = df.select(F.min(ts_col)).scalar()
        hi = df.select(F.max(ts_col)).scalar()
        return df.where((F.col(ts_col) > lo) & (F.col(ts_col) < hi))
    d = _key_join(df, bounds, keys, "inner")
    return d.where((F.col(ts_col) > F.col("__lo")) & (F.col(ts_col) < F.col("__hi"))).drop("__lo", "__hi")
