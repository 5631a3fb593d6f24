"""LLM serving energy per run (I5 GPU activity split, I6 energy report, E15).

All runs are handled by one plan: telemetry is tagged with its run by a
keyed range join (host + time bucket), and every per-run figure is an
aggregate keyed by ``run_id``; the per-run aggregates (one row per run) are
then joined. There is no loop over runs or GPUs and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wattspark.functions.timecols import epoch_us
from wattspark.operators.energy import integrate_power, integrate_cpu_energy
from wattspark.operators.joins import range_join

UTIL_ACTIVE_THRESHOLD_PCT = 1.0


def _in_runs(df: DataFrame, runs: DataFrame, host_col: str | None, bucket_s: float) -> DataFrame:
    r = runs.select("run_id", "start", "end", *([host_col] if host_col else []))
    return range_join(df, r, point_ts="timestamp", start="start", end="end",
                      keys=[host_col] if host_col else [], bucket_seconds=bucket_s)


def gpu_activity_split(gpu: DataFrame, runs: DataFrame, *, host_col: str = "host",
                       threshold: float = UTIL_ACTIVE_THRESHOLD_PCT, tiebreak=(),
                       bucket_s: float = 3600) -> DataFrame:
    """Per run, GPUs split by mean utilisation (active if >= threshold).

    A GPU is a (host, index) of a run, so equal indexes on several hosts stay apart.
    Output: run_id, active_gpus, avg_active_util, active_gpu_Wh, inactive_gpus,
    avg_inactive_util, inactive_gpu_Wh. Energy integrates every sample of a GPU
    inside the run (samples with NULL utilisation included). Without an ``index``
    column each host counts as one active GPU.
    """
    indexed = "index" in gpu.columns
    g = _in_runs(gpu if indexed else gpu.withColumn("index", F.lit("all")), runs, host_col, bucket_s)
    key = ["run_id", host_col, "index"]
    stats = (g.where(F.col("index").isNotNull() & F.col("utilization_gpu").isNotNull())
              .groupBy(*key).agg(F.avg("utilization_gpu").alias("avg_util")))
    e = integrate_power(g.where(F.col("index").isNotNull()), "timestamp", "power_draw", key, tiebreak=tiebreak)
    s = stats.join(e.select(*key, "energy_Wh"), key, "left")
    act = F.col("avg_util") >= threshold if indexed else F.lit(True)
    wh = F.coalesce(F.col("energy_Wh"), F.lit(0.0))
    return s.groupBy("run_id").agg(
        F.count_if(act).alias("active_gpus"),
        F.avg(F.when(act, F.col("avg_util"))).alias("avg_active_util"),
        F.coalesce(F.sum(F.when(act, wh)), F.lit(0.0)).alias("active_gpu_Wh"),
        F.count_if(~act).alias("inactive_gpus"),
        F.avg(F.when(~act, F.col("avg_util"))).alias("avg_inactive_util"),
        F.coalesce(F.sum(F.when(~act, wh)), F.lit(0.0)).alias("inactive_gpu_Wh"))


def mean_in_runs(series: DataFrame, runs: DataFrame, *, value: str, ts_col: str = "timestamp") -> DataFrame:
    """``run_id, mean`` of ``value`` over the series rows inside each run (closed), by running totals.

    Days carry totals of what is before them, so each run takes two lookups (just before its start,
    at its end) instead of a copy of every row inside it. Runs without a row are left out.
    """
    s = series.where(F.col(ts_col).isNotNull() & F.col(value).isNotNull()).select(
        F.to_date(ts_col).alias("day"), F.col(ts_col).alias("t"), F.lit(0).alias("o"), F.col(value).cast("double").alias("v"), F.lit(None).cast("string").alias("run_id"))
    marks = runs.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select("run_id", F.explode(F.array(
        F.struct(F.col("start").alias("t"), F.lit(-1).alias("o")), F.struct(F.col("end").alias("t"), F.lit(1).alias("o")))).alias("m"))
    q = marks.select(F.to_date("m.t").alias("day"), "m.t", "m.o", F.lit(None).cast("double").alias("v"), F.col("run_id").cast("string").alias("run_id"))
    u = s.unionByName(q)
    w = Window.partitionBy("day").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    run = u.select("*", F.coalesce(F.sum("v").over(w), F.lit(0.0)).alias("total"), F.count("v").over(w).alias("n")).where(F.col("run_id").isNotNull())
    # one row per day
    days = u.groupBy("day").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("dv"), F.count("v").alias("dn"))
    wd = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("day", F.coalesce(F.sum("dv").over(wd), F.lit(0.0)).alias("bv"), F.coalesce(F.sum("dn").over(wd), F.lit(0)).alias("bn"))
    at = run.join(before, "day").select("run_id", "o", (F.col("total") + F.col("bv")).alias("total"), (F.col("n") + F.col("bn")).alias("n"))
    out = at.groupBy("run_id").agg(F.sum(F.col("o") * F.col("total")).alias("total"), F.sum(F.col("o") * F.col("n")).alias("n"))
    return out.where(F.col("n") > 0).select("run_id", (F.col("total") / F.col("n")).alias("mean"))


def llm_energy_report(runs: DataFrame, gpu: DataFrame, ipmi: DataFrame, turbostat: DataFrame,
                      tokens: DataFrame, pue: DataFrame, *, host_col: str = "host",
                      psu_id: str = "0", unit: str = "W", tiebreak=(),
                      bucket_s: float = 3600) -> DataFrame:
    """Per run - model, active GPUs, tokens/s, mean active utilisation and
    Wh per 1k tokens (active GPU, inactive GPU, CPU, system, PUE-adjusted system).

    ``runs``: run_id, host, model, start, end; one row per host of a run. Series are
    integrated per (run, host) and summed per run. Runs without an active GPU or
    with no positive token total are dropped, as in the source analysis.
    """
    gs = gpu_activity_split(gpu, runs, host_col=host_col, tiebreak=tiebreak, bucket_s=bucket_s)
    tok = (_in_runs(tokens, runs, host_col, bucket_s)
           .groupBy("run_id").agg(F.sum("total_tokens").alias("total_tokens")))
    sys_p = ipmi.where((F.col("psu_id") == psu_id) & (F.col("unit") == unit))
    sys_e = (integrate_power(_in_runs(sys_p, runs, host_col, bucket_s), "timestamp", "value",
                             ["run_id", host_col], tiebreak=tiebreak)
             .groupBy("run_id").agg(F.sum("energy_Wh").alias("sys_Wh")))
    cpu_e = (integrate_cpu_energy(_in_runs(turbostat, runs, host_col, bucket_s),
                                  host_col=["run_id", host_col], tiebreak=tiebreak)
             .groupBy("run_id").agg(F.sum(F.col("pkg_energy_Wh") + F.col("ram_energy_Wh")).alias("cpu_Wh")))
    # a run has a row for each of its hosts
    runs = runs.groupBy("run_id").agg(*[F.min(c).alias(c) for c in ("model", "start")], F.max("end").alias("end"))
    avg_pue = mean_in_runs(pue, runs, value="ratio").withColumnRenamed("mean", "avg_pue")
    rep = (runs.join(gs.where(F.col("active_gpus") > 0), "run_id", "inner")
               .join(tok.where(F.col("total_tokens") > 0), "run_id", "inner")
               .join(sys_e, "run_id", "left").join(cpu_e, "run_id", "left")
               .join(avg_pue, "run_id", "left"))
    dur_s = (epoch_us("end") - epoch_us("start")) / F.lit(1_000_000.0)
    t = F.col("total_tokens")
    per_k = lambda c: F.col(c) / t * F.lit(1000.0)
    return rep.select(
        "run_id", F.col("model"), "active_gpus",
        F.when(dur_s > 0, t / dur_s).otherwise(F.lit(0.0)).alias("tokens_per_s"),
        F.col("avg_active_util").alias("avg_active_gpu_util"),
        per_k("active_gpu_Wh").alias("active_gpu_Wh_per_1k"),
        per_k("inactive_gpu_Wh").alias("inactive_gpu_Wh_per_1k"),
        per_k("cpu_Wh").alias("cpu_Wh_per_1k"),
        per_k("sys_Wh").alias("system_Wh_per_1k"),
        (F.col("sys_Wh") / t * F.col("avg_pue") * F.lit(1000.0)).alias("adjusted_Wh_per_1k"))
