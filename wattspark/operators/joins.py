"""Joins the analyses need and Spark has no single operator for.

``range_join`` matches timestamped points with [start, end] intervals. The
intervals are exploded into fixed time buckets, the join is an equi-join on
(keys, bucket) - hash/sort-merge/broadcast as Catalyst and AQE decide - and
the exact closed-interval predicate is applied after. Each point falls in one
bucket, so no pair is produced twice and no interval is compared with points
outside its buckets (no nested-loop or cartesian join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattspark.functions.timecols import epoch_us, add_seconds

DEFAULT_BUCKET_S = 3600


def _bucket(ts, width_us: int) -> F.Column:
    return F.floor(epoch_us(ts) / F.lit(width_us)).cast("long")


def range_join(points: DataFrame, intervals: DataFrame, *, point_ts: str, start: str, end: str,
               keys=(), pad_seconds: float = 0.0, bucket_seconds: float = DEFAULT_BUCKET_S,
               how: str = "inner") -> DataFrame:
    """Points with ``start - pad <= ts <= end + pad`` of an interval with equal ``keys``.

    ``how='inner'`` returns point columns + interval columns (a point inside two
    intervals appears twice); ``how='left_semi'`` keeps each matching point once
    (the union-of-intervals filter, D5).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    width = int(bucket_seconds * 1_000_000)
    lo, hi = F.col(start), F.col(end)
    if pad_seconds:
        lo, hi = add_seconds(lo, -pad_seconds), add_seconds(hi, pad_seconds)
    iv = (intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull())
                   .withColumn("__lo", lo).withColumn("__hi", hi)
                   .where(F.col("__hi") >= F.col("__lo"))
                   .withColumn("__b", F.explode(F.sequence(_bucket("__lo", width), _bucket("__hi", width)))))
    pts = points.withColumn("__pb", _bucket(point_ts, width))
    cond = (pts["__pb"] == iv["__b"])
    for k in keys:
        cond = cond & (pts[k] == iv[k])
    pt = pts[point_ts]
    cond = cond & (pt >= iv["__lo"]) & (pt <= iv["__hi"])
    if how == "left_semi":
        return pts.join(iv, cond, "left_semi").drop("__pb")
    if how != "inner":
        raise ValueError("how must be 'inner' or 'left_semi'")
    j = pts.join(iv, cond, "inner")
    # drop the interval's copy of the keys and the helper columns
    out = j.select(pts["*"], *[iv[c] for c in intervals.columns if c not in keys])
    return out.drop("__pb")


#: levels of dyadic cells: 2 ** 40 base cells cover any time range
LEVELS = 40


def dyadic_cells(low: F.Column, high: F.Column) -> F.Column:
    """The fewest aligned cells of 2 ** level base cells that make up the base cells ``low`` to ``high``: an array of
    (level, cell) with at most two entries a level."""
    def at(i):
        a, b = -F.call_function("shiftright", -low, i), F.call_function("shiftright", high + 1, i)  # [ceil, floor)
        one = F.lit(1).cast("long")
        left = F.when((a < b) & (a.bitwiseAND(one) == 1), F.struct(i.alias("level"), a.alias("cell")))
        right = F.when((a < b) & (b.bitwiseAND(one) == 1), F.struct(i.alias("level"), (b - 1).alias("cell")))
        return F.array(left, right)
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at)))


def dyadic_join(points: DataFrame, intervals: DataFrame, *, point_ts: str, start: str, end: str,
                keys=(), pad_seconds: float = 0.0, base_seconds: float = 1.0) -> DataFrame:
    """Like :func:`range_join`, for intervals of very different lengths.

    An interval is cut into aligned cells of 1, 2, 4, .. base cells, at most two of each size: a month costs some forty
    rows, a second one or two, where one bucket width must suit both. A point looks up its cell on each level that an
    interval uses (at most ``LEVELS``, known from one small aggregate); the cells of an interval are disjoint, so a pair meets once.
    The cells are many times the intervals that Spark has statistics of, so they are never broadcast: both sides are shuffled and merged.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    width = int(base_seconds * 1_000_000)
    lo, hi = F.col(start), F.col(end)
    if pad_seconds:
        lo, hi = add_seconds(lo, -pad_seconds), add_seconds(hi, pad_seconds)
    iv = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *[F.col(k).alias(f"__i_{k}") for k in keys], F.struct(*[c for c in intervals.columns if c not in keys]).alias("__iv"), lo.alias("__lo"), hi.alias("__hi")).where("__hi >= __lo")
    iv = iv.select("*", F.inline(dyadic_cells(_bucket("__lo", width), _bucket("__hi", width)))).hint("merge")
    used = sorted(r.level for r in iv.select("level").distinct().collect())
    if not used:
        used = [0]
    cells = F.array(*[F.struct(F.lit(n).alias("__level"), F.shiftright("__base", n).alias("__cell")) for n in used])
    pts = points.select(*points.columns, _bucket(point_ts, width).alias("__base")).select(*points.columns, F.inline(cells))
    cond = (F.col("__level") == F.col("level")) & (F.col("__cell") == F.col("cell"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__i_{k}"))
    inside = (F.col(point_ts) >= F.col("__lo")) & (F.col(point_ts) <= F.col("__hi"))
    return pts.join(iv, cond).where(inside).select(*points.columns, *[F.col("__iv")[c].alias(c) for c in intervals.columns if c not in keys])


def islands(intervals: DataFrame, *, start: str = "start", end: str = "end", keys=(),
            bucket_seconds: float = DEFAULT_BUCKET_S) -> DataFrame:
    """Disjoint stretches of the union of intervals: one row per (keys, time bucket), ``__b``, with a sorted
    array ``__islands`` of ``lo, hi`` that covers what the intervals cover of that bucket.

    Intervals are cut at bucket edges, so a bucket needs nothing of its neighbours; equal starts
    are merged by a partial aggregate before the window over one bucket's pieces.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    width = int(bucket_seconds * 1_000_000)
    iv = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(end) >= F.col(start)))
    pieces = (iv.select(*keys, epoch_us(start).alias("__s"), epoch_us(end).alias("__e"),
                        F.explode(F.sequence(_bucket(start, width), _bucket(end, width))).alias("__b"))
                .select(*keys, "__b", F.greatest("__s", F.col("__b") * width).alias("__lo"),
                        F.least("__e", (F.col("__b") + 1) * width).alias("__hi"))
                .groupBy(*keys, "__b", "__lo").agg(F.max("__hi").alias("__hi")))
    w = Window.partitionBy(*keys, "__b").orderBy("__lo")
    reach = F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = pieces.withColumn("__new", F.when(reach.isNull() | (F.col("__lo") > reach), 1).otherwise(0))
    cut = cut.withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = cut.groupBy(*keys, "__b", "__i").agg(F.min("__lo").alias("lo"), F.max("__hi").alias("hi"))
    return merged.groupBy(*keys, "__b").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__islands"))


def interval_union_filter(points: DataFrame, intervals: DataFrame, *, point_ts: str,
                          start: str = "start", end: str = "end", keys=(),
                          bucket_seconds: float = DEFAULT_BUCKET_S) -> DataFrame:
    """Keep points inside ANY interval, each once; no interval -> no rows.

    Each point meets one row, the islands of its (keys, bucket), however many intervals overlap there.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    width = int(bucket_seconds * 1_000_000)
    isl = islands(intervals, start=start, end=end, keys=keys, bucket_seconds=bucket_seconds)
    isl = isl.select(*[F.col(k).alias(f"__i_{k}") for k in keys], F.col("__b").alias("__ib"), "__islands")
    pts = points.withColumn("__pb", _bucket(point_ts, width))
    cond = F.col("__pb") == F.col("__ib")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"__i_{k}"))
    t = epoch_us(point_ts)
    inside = F.exists("__islands", lambda x: (t >= x["lo"]) & (t <= x["hi"]))
    return pts.join(isl, cond).where(inside).select(*points.columns)
