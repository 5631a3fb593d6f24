"""Power -> energy (I2, I3, I4): trapezoid rule over each power series.

For consecutive samples (t0, p0), (t1, p1) of a series the interval energy is
``(p0 + p1) / 2 * dt`` with ``dt`` the whole milliseconds between them in
seconds. Rows with a NULL time or power are removed first; intervals with
``dt <= 0`` (duplicate timestamps) contribute nothing, but the duplicate row
is still the "previous" sample of the next one. Totals are reported in J, Wh
and kWh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattspark.operators.timeseries import chunked_lag, _cols


def power_intervals(df: DataFrame, ts_col: str = "timestamp", p_col: str = "power_draw",
                    keys=(), *, tiebreak=(), chunk_seconds: float | None = None,
                    prefix: str = "") -> DataFrame:
    """Per-interval detail: keys, ts, dt_ms, dt_s, p_avg_W, dE_J, dE_Wh, dE_kWh."""
    keys, tiebreak = _cols(keys), _cols(tiebreak)
    d = df.select(*keys, ts_col, p_col, *tiebreak).dropna(subset=[ts_col, p_col])
    d = chunked_lag(d, keys, ts_col, [ts_col, p_col], tiebreak=tiebreak,
                    chunk_seconds=chunk_seconds, prefix="__prev_")
    dt_ms = F.timestamp_diff("MILLISECOND", F.col("__prev_" + ts_col), F.col(ts_col))
    d = (d.withColumn("dt_ms", dt_ms)
          .withColumn("dt_s", F.col("dt_ms") / F.lit(1000.0))
          .withColumn(prefix + "p_avg_W", (F.col(p_col) + F.col("__prev_" + p_col)) / F.lit(2.0))
          .where(F.col("dt_s").isNotNull() & (F.col("dt_s") > 0)))
    e = F.col(prefix + "p_avg_W") * F.col("dt_s")
    return (d.withColumn(prefix + "dE_J", e)
             .withColumn(prefix + "dE_Wh", e / F.lit(3600.0))
             .withColumn(prefix + "dE_kWh", e / F.lit(3_600_000.0))
             .drop("__prev_" + ts_col, "__prev_" + p_col))


def integrate_power(df: DataFrame, ts_col: str = "timestamp", p_col: str = "power_draw",
                    keys=(), *, tiebreak=(), chunk_seconds: float | None = None,
                    prefix: str = "") -> DataFrame:
    """Energy totals per series key (``energy_J``, ``energy_Wh``, ``energy_kWh``).

    A key appears only if it has at least one positive-length interval. With no
    keys the result is one row (zeros for empty input).
    """
    keys = _cols(keys)
    w = power_intervals(df, ts_col, p_col, keys, tiebreak=tiebreak,
                        chunk_seconds=chunk_seconds, prefix=prefix)
    units = ("J", "Wh", "kWh")
    if not keys:
        return w.agg(*[F.coalesce(F.sum(prefix + "dE_" + u), F.lit(0.0)).alias(prefix + "energy_" + u)
                       for u in units])
    return w.groupBy(*keys).agg(*[F.sum(prefix + "dE_" + u).alias(prefix + "energy_" + u)
                                  for u in units])


def integrate_cpu_energy(df: DataFrame, ts_col: str = "timestamp", host_col="host",
                         pkg_col: str = "package_power_watt", ram_col: str = "ram_power_watt",
                         die_col: str = "die", *, tiebreak=(),
                         chunk_seconds: float | None = None) -> DataFrame:
    """I4: package and DRAM energy per host (one or more key columns) from the roll-up rows (``die == '-'``).

    Both power columns must be non-NULL on a row for it to count.
    """
    tiebreak, hosts = _cols(tiebreak), _cols(host_col)
    d = (df.where(F.col(die_col) == "-")
           .select(*hosts, ts_col, pkg_col, ram_col, *tiebreak)
           .dropna(subset=[ts_col, pkg_col, ram_col]))
    d = chunked_lag(d, hosts, ts_col, [ts_col, pkg_col, ram_col], tiebreak=tiebreak,
                    chunk_seconds=chunk_seconds, prefix="__prev_")
    dt_s = F.timestamp_diff("MILLISECOND", F.col("__prev_" + ts_col), F.col(ts_col)) / F.lit(1000.0)
    d = d.withColumn("dt_s", dt_s).where(F.col("dt_s").isNotNull() & (F.col("dt_s") > 0))
    pkg = (F.col(pkg_col) + F.col("__prev_" + pkg_col)) / F.lit(2.0) * F.col("dt_s")
    ram = (F.col(ram_col) + F.col("__prev_" + ram_col)) / F.lit(2.0) * F.col("dt_s")
    return d.groupBy(*hosts).agg(
        F.sum(pkg).alias("pkg_energy_J"), F.sum(pkg / 3600.0).alias("pkg_energy_Wh"),
        F.sum(pkg / 3_600_000.0).alias("pkg_energy_kWh"),
        F.sum(ram).alias("ram_energy_J"), F.sum(ram / 3600.0).alias("ram_energy_Wh"),
        F.sum(ram / 3_600_000.0).alias("ram_energy_kWh"))
