"""Distribution summaries from mergeable states kept per day.

``day_states`` reduces a table to one row per day and column: count, sum, sum of squares, extremes, a KLL sketch of the
values and an HLL sketch of the distinct ones. States of days merge to the state of any set of days, so
a summary of months reads some kilobytes per day and an appended day is the only one that is read again
(:class:`SketchTable`). The exact profile (``operators.quality``) stays the reference; the rank error of a KLL sketch of size ``k`` is
about ``2.3 / k ** 0.9`` (0.6 % at the default), whatever the number of rows; a test and a query measure it against the exact ranks.

Defined results: NULLs are counted (``nulls``) and in no other figure; a column without a value gives NULL figures and 0
distinct values; rows without a time are of the day NULL. NaN, which has no rank, counts as NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattspark.sources.snapshots import SnapshotTable

#: size of a quantile sketch, and the logarithm of the number of registers of a distinct sketch
K, REGISTERS = 400, 14


def day_states(df: DataFrame, cols: Sequence[str], ts_col: str = "timestamp", k: int = K) -> DataFrame:
    """``day, col, n, nulls, mean, m2, low, high, kll, hll``: one scan, one exchange of a row per task, day and column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("v")) for c in cols]))
    rows = df.select(F.to_date(ts_col).alias("day"), pairs.alias("x")).select("day", "x.col", (F.col("x.v") + F.lit(0.0)).alias("v"))  # -0.0 is 0.0
    v = F.col("v")
    return rows.groupBy("day", "col").agg(
        F.count(v).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(k)).alias("kll"),
        F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), F.lit(REGISTERS)).alias("hll"))


def summarise(states: DataFrame, qs: dict[str, float] | None = None) -> DataFrame:
    """``col, n, nulls, mean, std, min, max, distinct`` and a column per entry of ``qs`` (name -> rank from 0 to 1), over all given states."""
    qs = {"q25": 0.25, "median": 0.5, "q75": 0.75} if qs is None else qs
    total = states.groupBy("col").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
                                      F.min("low").alias("min"), F.max("high").alias("max"), F.kll_merge_agg_double("kll").alias("__kll"),
                                      F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("distinct"))
    # squared deviations: within a day, and of a day's mean from the whole mean
    spread = states.select("col", "m2", "n", F.col("mean").alias("day_mean")).join(total.select("col", "mean"), "col")
    spread = spread.groupBy("col").agg(F.sum(F.col("m2") + F.col("n") * (F.col("day_mean") - F.col("mean")) ** 2).alias("m2"))
    ranks = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("__kll", F.lit(float(q)))).alias(name) for name, q in qs.items()]
    out = total.join(spread, "col").withColumn("std", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))
    return out.select("col", "n", "nulls", "mean", "std", "min", "max", "distinct", *ranks)


class SketchTable:
    """States per day of the columns ``cols``, kept in a snapshot table at ``root``."""

    def __init__(self, spark: SparkSession, root: str, cols: Sequence[str], ts_col: str = "timestamp", k: int = K):
        self.cols, self.ts_col, self.k = list(cols), ts_col, k
        self.table = SnapshotTable(spark, root, order=["day", "col"])

    def add(self, df: DataFrame, token: str | None = None) -> int:
        """Loads the states of ``df``, of any days, once per token. Late rows of a day are a further state of that day."""
        return self.table.load(day_states(df, self.cols, self.ts_col, self.k), token=token)

    def summary(self, start=None, end=None, qs: dict[str, float] | None = None) -> DataFrame:
        """:func:`summarise` over the days in [``start``, ``end``) (dates; None: open, and then rows without a time count too)."""
        states = self.table.read() if start is None and end is None else self.table.scan({"day": (start, end)})
        return summarise(states, qs)
