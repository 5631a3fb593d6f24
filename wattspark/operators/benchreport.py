"""Benchmark-grid reports.

Input grid: one row per (db, ram, cpus, iteration) with a throughput metric.
All steps are group-bys on the small configuration keys after a map-side
partial aggregation; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wattspark.functions.timecols import bucket_start


def mean_std(grid: DataFrame, metric: str = "rate", keys=("db", "ram", "cpus")) -> DataFrame:
    """Mean and sample standard deviation per configuration (std NULL for n=1)."""
    return grid.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
                                   F.count(F.lit(1)).alias("n"))


def pivot_mean(stats: DataFrame, row: str = "ram", col: str = "cpus", value: str = "mean", keys=("db",)) -> DataFrame:
    """``row`` x ``col`` matrix of means (one matrix per ``keys``), columns ``<col>_<v>``.

    Spark finds the pivot values in the data, so none is lost (it refuses more than
    ``spark.sql.pivotMaxValues``).
    """
    p = stats.groupBy(*keys, row).pivot(col).agg(F.avg(value))
    return p.select(*keys, row, *[F.col(f"`{v}`").alias(f"{col}_{v}") for v in p.columns[len(keys) + 1:]])


def argmax_row(stats: DataFrame, by: str = "mean", keys=("db",), cols=("ram", "cpus", "mean", "std")) -> DataFrame:
    """The configuration with the largest ``by`` per key (ties: smallest ram, cpus)."""
    order = F.struct(F.col(by), -F.col("ram"), -F.col("cpus"))
    best = stats.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("b"))
    return best.select(*keys, *[F.col("b." + c).alias(c) for c in cols])


def mean_of_means(stats: DataFrame, keys=("db",), value: str = "mean") -> DataFrame:
    """Mean over configurations per key (order by it descending at the output)."""
    return stats.groupBy(*keys).agg(F.avg(value).alias("mean_of_means"))


def scaling_summary(stats: DataFrame, baseline_cpus: int | None = None, target_cpus: int | None = None,
                    keys=("db",), value: str = "mean", scale: float = 1e6) -> DataFrame:
    """Min / max / mean of the throughput (in millions) per key, and the ratio of
    the mean at ``target_cpus`` to the mean at ``baseline_cpus`` (default: the
    smallest and largest core counts present for the key)."""
    s = stats.withColumn("__m", F.col(value) / F.lit(scale))
    agg = s.groupBy(*keys).agg(
        F.min("__m").alias("min_M"), F.max("__m").alias("max_M"), F.avg("__m").alias("mean_M"),
        F.min("cpus").alias("__lo"), F.max("cpus").alias("__hi"))
    j = s.join(agg.select(*keys, "__lo", "__hi"), list(keys))
    lo = F.lit(baseline_cpus) if baseline_cpus is not None else F.col("__lo")
    hi = F.lit(target_cpus) if target_cpus is not None else F.col("__hi")
    r = j.groupBy(*keys).agg(F.avg(F.when(F.col("cpus") == lo, F.col("__m"))).alias("__b"),
                             F.avg(F.when(F.col("cpus") == hi, F.col("__m"))).alias("__t"))
    out = agg.join(r, list(keys))
    return out.select(*keys, "min_M", "max_M", "mean_M",
                      F.try_divide(F.col("__t"), F.col("__b")).alias("scaling"))


def slices(stats: DataFrame, fixed_ram: int, fixed_cpus: int) -> DataFrame:
    """Fixed-RAM slice (varying cpus), fixed-CPU slice (varying ram) and the databases side by
    side at that one configuration, labelled."""
    a = stats.where(F.col("ram") == fixed_ram).select(F.lit("fixed_ram").alias("slice"), "*")
    b = stats.where(F.col("cpus") == fixed_cpus).select(F.lit("fixed_cpus").alias("slice"), "*")
    c = stats.where((F.col("ram") == fixed_ram) & (F.col("cpus") == fixed_cpus)).select(F.lit("one_config").alias("slice"), "*")
    return a.unionByName(b).unionByName(c)


def benchmark_report(grid: DataFrame, metric: str = "rate") -> DataFrame:
    """Per configuration mean, std, mean +- std band, throughput in millions,
    rank within the db (1 = best) and whether it is the db's best."""
    from pyspark.sql import Window
    s = mean_std(grid, metric)
    w = Window.partitionBy("db").orderBy(F.col("mean").desc(), "ram", "cpus")
    # one row per configuration: the window input is tiny (grid cells, not raw rows)
    s = s.withColumn("rank", F.row_number().over(w))
    return s.select("db", "ram", "cpus", "n", "mean", "std",
                    (F.col("mean") - F.col("std")).alias("band_lo"),
                    (F.col("mean") + F.col("std")).alias("band_hi"),
                    (F.col("mean") / F.lit(1e6)).alias("throughput_M"), "rank",
                    (F.col("rank") == 1).alias("is_best"))


def devops_groupby(cpu: DataFrame, metrics: Sequence[str], *, hosts=None, start=None, end=None,
                   every_s: int = 60) -> DataFrame:
    """Per host and minute, MAX of each CPU metric; optional host list / time range
    (the benchmark draws one host and 12 h at random)."""
    d = cpu
    if hosts is not None:
        d = d.where(F.col("host").isin(list(hosts)))
    if start is not None:
        d = d.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        d = d.where(F.col("timestamp") < F.lit(end))
    return d.groupBy("host", bucket_start("timestamp", every_s).alias("minute")).agg(
        *[F.max(m).alias("max_" + m) for m in metrics])


def llm_request_stats(requests: DataFrame, keys=("path", "model")) -> DataFrame:
    """Per run log: requests, token totals, tokens/s and latency summary
    (mergeable aggregates only)."""
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.try_divide(F.sum("total_tokens"), F.sum("seconds")).alias("tokens_per_s"),
        F.avg("seconds").alias("mean_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"))


def latency_percentiles(requests: DataFrame, qs=(0.5, 0.9, 0.95, 0.99), keys=("model",), value: str = "seconds") -> DataFrame:
    """Exact nearest-rank percentiles of ``value`` per key, ``p50`` and so on.

    From a histogram: one row per distinct value (seconds with two decimals), so a key's window holds
    its value domain and not its requests.
    """
    from pyspark.sql import Window
    hist = requests.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*keys)
    h = hist.select("*", F.sum("__c").over(w.orderBy(value)).alias("__cum"), F.sum("__c").over(w).alias("__n"))
    return h.groupBy(*keys).agg(F.max("__n").alias("requests"), *[
        F.min(F.when(F.col("__cum") > F.round((F.col("__n") - 1) * F.lit(q)), F.col(value))).alias(f"p{round(q * 100)}") for q in qs])
