"""Site power: PDU / IPMI / meter series, PUE and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattspark.functions.safe import nz_sum
from wattspark.operators.timeseries import tumbling_agg, trim_ends


def meter_power_10m(meter: DataFrame, description: str, every_s: int = 600) -> DataFrame:
    """Mean meter power per bucket for one exact description: (timestamp, value)."""
    m = meter.where(F.col("description") == description)
    return tumbling_agg(m, "timestamp", every_s, [], [F.avg("value").alias("value")])


def pdu_total(pdu: DataFrame, every_s: int = 600, devices: DataFrame | None = None,
              device_col: str = "connected_device") -> DataFrame:
    """Mean per (device, port, bucket), summed per bucket -> (timestamp, total_power_W).

    ``devices`` (one column ``device_col``) restricts to the listed devices
    (left-semi join, so the list is never collected to the driver).
    """
    per_port = tumbling_agg(pdu, "timestamp", every_s, [device_col, "port"],
                            [F.avg("value_W").alias("value_W")])
    if devices is not None:
        per_port = per_port.join(devices.select(device_col), device_col, "left_semi")
    return per_port.groupBy("timestamp").agg(nz_sum("value_W").alias("total_power_W"))


def ipmi_total(ipmi: DataFrame, every_s: int = 600, psu_id: str = "0", unit: str = "W") -> DataFrame:
    """E3 + E4: per (host, bucket) mean of rows with the PSU/unit, summed over hosts.

    A host whose bucket has no matching row keeps a NULL mean (filtered mean),
    and a bucket of only such hosts sums to 0.
    """
    keep = (F.col("psu_id") == psu_id) & (F.col("unit") == unit)
    per_host = tumbling_agg(ipmi, "timestamp", every_s, ["host"],
                            [F.avg(F.when(keep, F.col("value"))).alias("value_W")])
    return per_host.groupBy("timestamp").agg(nz_sum("value_W").alias("total_power_W"))


def pue_series(meter: DataFrame, pdu: DataFrame, description: str, every_s: int = 600) -> DataFrame:
    """Meter bucket mean / PDU bucket total, joined on the bucket -> (timestamp, ratio)."""
    m = meter_power_10m(meter, description, every_s)
    p = pdu_total(pdu, every_s)
    return (m.join(p, "timestamp", "inner")
             .select("timestamp", F.try_divide(F.col("value"), F.col("total_power_W")).alias("ratio")))


def short_host(col: str = "host") -> F.Column:
    """H4: host name before the first dot."""
    return F.split_part(F.col(col), F.lit("."), F.lit(1))


def missing_devices(pdu: DataFrame, ipmi: DataFrame, device_col: str = "connected_device") -> DataFrame:
    """PDU devices that are not IPMI hosts (short names): distinct + anti join."""
    p = pdu.select(device_col).distinct()
    i = ipmi.select(short_host("host").alias(device_col)).distinct()
    return p.join(i, device_col, "left_anti")


def power_reconciliation(pdu: DataFrame, ipmi: DataFrame, meter: DataFrame, description: str,
                         listed_devices: DataFrame | None = None, every_s: int = 600) -> DataFrame:
    """I8: per bucket, in kW: PDU total, IPMI total, listed non-IPMI PDU devices,
    IPMI + those, and the meter; first and last bucket dropped (partial windows).

    ``listed_devices`` defaults to the PDU devices absent from IPMI (D6).
    """
    if listed_devices is None:
        listed_devices = missing_devices(pdu, ipmi)
    kw = lambda c: (F.col(c) / F.lit(1000.0))
    p = pdu_total(pdu, every_s).select("timestamp", kw("total_power_W").alias("pdu_kW"))
    i = ipmi_total(ipmi, every_s).select("timestamp", kw("total_power_W").alias("ipmi_kW"))
    m = pdu_total(pdu, every_s, devices=listed_devices).select(
        "timestamp", kw("total_power_W").alias("missing_kW"))
    e = meter_power_10m(meter, description, every_s).select("timestamp", kw("value").alias("meter_kW"))
    out = p.join(i, "timestamp", "full").join(m, "timestamp", "full").join(e, "timestamp", "full")
    out = out.withColumn("ipmi_plus_missing_kW", F.col("ipmi_kW") + F.col("missing_kW"))
    return trim_ends(out, "timestamp")


def weather_overlay(weather: DataFrame, series: DataFrame, date_col: str = "date",
                    ts_col: str = "timestamp") -> DataFrame:
    """C14: weather rows within [min, max] of a series (bounds are scalar sub-queries)."""
    lo = series.select(F.min(ts_col)).scalar()
    hi = series.select(F.max(ts_col)).scalar()
    return weather.where((F.col(date_col) >= lo) & (F.col(date_col) <= hi))
