"""Semantic micro-tests of the energy, runs, GPU split and quality operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattspark.operators import energy, runs as R, llm as L, quality as Q, power as P, io as IO

T0 = dt.datetime(2024, 1, 1)


def t(s, us=0):
    return T0 + dt.timedelta(seconds=s, microseconds=us)


def test_trapezoid_ms_truncation_duplicates_nulls(spark):
    rows = [(1, t(0), "h", 100.0), (2, t(1, 999), "h", 200.0),   # dt = 1000 ms (999 us truncated)
            (3, t(1, 999), "h", 400.0),                            # duplicate time: dt = 0, no energy
            (4, t(3), "h", None),                                  # NULL power removed first
            (5, t(4), "h", 0.0)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz, host string, p double")
    tot = energy.integrate_power(df, "timestamp", "p", ["host"], tiebreak=["id"]).first()
    # (100+200)/2 * 1.000 s + (400+0)/2 * 2.999 s (2999.001 ms truncated); the duplicate is the "previous"
    exp = 150 * 1.000 + 200 * 2.999
    assert tot.energy_J == pytest.approx(exp)
    assert tot.energy_Wh == pytest.approx(exp / 3600)
    assert tot.energy_kWh == pytest.approx(exp / 3.6e6)


def test_integrate_empty_and_single(spark):
    df = spark.createDataFrame([(1, t(0), 5.0)], "id long, timestamp timestamp_ntz, p double")
    assert energy.integrate_power(df, "timestamp", "p").first().energy_J == 0.0
    assert energy.integrate_power(df, "timestamp", "p", ["id"]).count() == 0


def test_cpu_energy_rollup_rows_only(spark):
    rows = [(t(0), "h", "-", 10.0, 1.0), (t(2), "h", "-", 30.0, 3.0), (t(1), "h", "0", 999.0, 999.0),
            (t(3), "h", "-", None, 5.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, host string, die string, "
                                     "package_power_watt double, ram_power_watt double")
    r = energy.integrate_cpu_energy(df).first()
    assert (r.pkg_energy_J, r.ram_energy_J) == (40.0, 4.0)


def test_pivot_runs_and_unmatched_start(spark):
    rows = [(t(0), "1", "START", "m"), (t(10), "1", "END", "m"), (t(20), "2", "START", "m")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, SLURM_JOB_ID string, status string, notes string")
    assert [r.SLURM_JOB_ID for r in R.pivot_runs(df, ["SLURM_JOB_ID", "notes"]).collect()] == ["1"]
    assert R.pivot_runs(df, ["SLURM_JOB_ID"], require_both=False).count() == 2


def test_parse_notes_and_pairing(spark):
    rows = [(t(0), "START", "IOR-backend=posix-scenario=read_seq_4k_1"), (t(5), "END", "IOR-backend=posix-scenario=read_seq_4k_1"),
            (t(6), "START", "IOR-backend=posix-scenario=read_seq_4k_2"), (t(4), "END", "IOR-backend=posix-scenario=read_seq_4k_2"),
            (t(7), "START", "IOR-idle")]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, status string, notes string")
    p = R.parse_ior_notes(df)
    assert {(r.backend, r.scenario, r.iter) for r in p.collect()} == {("POSIX", "read_seq_4k", 1), ("POSIX", "read_seq_4k", 2)}
    pairs = R.pair_start_end(p, ["backend", "scenario"]).orderBy("idx").collect()
    # k-th START with k-th END by time: (0, 4) kept, (6, 5) dropped since end < start
    assert [(r.start, r.end) for r in pairs] == [(t(0), t(4))]


def test_gpu_split_idle_and_threshold(spark):
    runs = spark.createDataFrame([("r1", "h", t(0), t(100))], "run_id string, host string, start timestamp_ntz, end timestamp_ntz")
    g = [(t(s), "h", gi, u, 100.0, s) for s in (0, 10, 20) for gi, u in (("0", 50.0), ("1", 0.5))]
    g += [(t(200), "h", "0", 90.0, 100.0, 999)]   # outside the run
    gpu = spark.createDataFrame(g, "timestamp timestamp_ntz, host string, index string, utilization_gpu double, "
                                   "power_draw double, event_id long")
    r = L.gpu_activity_split(gpu, runs, tiebreak=["event_id"]).first()
    assert (r.active_gpus, r.inactive_gpus, r.avg_active_util, r.avg_inactive_util) == (1, 1, 50.0, 0.5)
    assert r.active_gpu_Wh == pytest.approx(2000 / 3600) and r.inactive_gpu_Wh == pytest.approx(2000 / 3600)


def test_hist_quantiles_match_nearest_rule(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 50, size=301).tolist()
    df = spark.createDataFrame([(int(v),) for v in vals], "x long")
    s = Q.distribution_summary(df, "x").first()
    srt = np.sort(vals)
    n = len(srt)
    nearest = lambda q: float(srt[int(np.floor((n - 1) * q + 0.5))])  # noqa: E731 (half up)
    assert (s.q25, s.q75) == (nearest(0.25), nearest(0.75))
    assert s.median == float(np.median(srt))
    assert s.std == pytest.approx(float(np.std(srt, ddof=1)))


def test_distribution_summary_empty_and_single(spark):
    """Empty input gives one row of NULLs; one value gives a NULL sample std."""
    empty = Q.distribution_summary(spark.createDataFrame([], "x long"), "x").collect()
    assert len(empty) == 1 and all(v is None for v in empty[0])
    one = Q.distribution_summary(spark.createDataFrame([(7,)], "x long"), "x").first()
    assert (one.mean, one.median, one.q25, one.q75, one.min, one.max, one.std) == (7.0, 7.0, 7.0, 7.0, 7.0, 7.0, None)


def test_side_by_side_one_row_frames(spark):
    a = spark.createDataFrame([(1, None)], "a long, b double")
    b = spark.createDataFrame([(2.5,)], "c double")
    out = Q.side_by_side(a, b)
    assert out.columns == ["a", "b", "c"]
    assert out.collect() == [(1, None, 2.5)]
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in p and "CartesianProduct" not in p


def test_round_delta_half_up(spark):
    df = spark.createDataFrame([(t(0, 500000),), (t(0, 499999),), (t(0, 700000),)], "timestamp timestamp_ntz")
    got = sorted(r.delta_us for r in Q.with_round_delta(df).collect())
    assert got == [300000, 499999, 500000]


def test_filtered_mean_sum_of_nulls_is_zero(spark):
    rows = [(t(0), "h1", "1", "W", 10.0), (t(1), "h2", "0", "A", 5.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, host string, psu_id string, unit string, value double")
    assert P.ipmi_total(df).first().total_power_W == 0.0


def test_efficiency_guards(spark):
    s = spark.createDataFrame([("POSIX", "s", 1.0, 2.0, 0.0, 0.0, 0.0)],
                              "backend string, scenario string, mean_MBps_per_watt double, mean_iops_per_watt double, "
                              "mean_MBps double, mean_iops double, mean_power_W double")
    perf = spark.createDataFrame([("f", "s", "POSIX", 100.0, 5.0)], "fs_type string, scenario string, api string, "
                                 "bw_MiB double, iops double")
    r = IO.efficiency_comparison(s, perf).first()
    assert (r.IOR_MBps_per_watt, r.bw_rateo, r.iops_rateo) == (0.0, 0.0, 0.0)


def test_io_efficiency_empty_group_gives_nulls(spark):
    tt = spark.createDataFrame([("B", "s", 1, "START", t(0)), ("B", "s", 1, "END", t(5))],
                               "backend string, scenario string, iter long, status string, timestamp timestamp_ntz")
    disk = spark.createDataFrame([(t(1000), "h", "d") + (1,) * 10],
                                 "timestamp timestamp_ntz, host string, name string, " +
                                 ", ".join(f"{c} long" for c in IO.DISK_COUNTERS))
    pw = spark.createDataFrame([(t(1000), "h", 100.0)], "timestamp timestamp_ntz, host string, value double")
    r = IO.io_power_efficiency(disk, pw, tt).collect()
    assert len(r) == 1 and r[0].mean_MBps is None and r[0].mean_power_W is None
