"""Scans and loads that must not lose data in silence; unions of intervals; escaped tags."""

from __future__ import annotations

import datetime as dt
import os
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from wattspark.operators.joins import interval_union_filter
from wattspark.sources import formats as FM, lake as LK, telemetry as TS

SF = "/root/testdata/sf0.001"


def _folder(spark, tmpdir_path, name, files=4):
    path = os.path.join(tmpdir_path, name)
    spark.range(100).select("id", F.lit(1.5).alias("a"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("timestamp")).repartition(files).write.parquet(path)
    return path


def test_a_damaged_file_fails_the_scan_unless_tolerant(spark, tmpdir_path):
    path = _folder(spark, tmpdir_path, "damaged")
    hurt = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))[0]
    schema = spark.read.parquet(path).schema
    with open(os.path.join(path, hurt), "wb") as f:
        f.write(b"not parquet at all")
    with pytest.raises(Exception):
        TS.telemetry_scan(spark, path, schema=schema).count()
    left = TS.telemetry_scan(spark, path, schema=schema, tolerant=True).count()
    assert 0 < left < 100
    skipped = TS.skipped_files(spark, path, schema, ["a"]).collect()
    assert [(os.path.basename(r.file), r.reason) for r in skipped] == [(hurt, TS.UNREADABLE)]


def test_a_file_without_a_requested_column_is_skipped_and_reported(spark, tmpdir_path):
    path = _folder(spark, tmpdir_path, "lacking")
    schema = spark.read.parquet(path).schema
    spark.range(7).withColumn("timestamp", F.expr("timestamp_ntz'2024-01-01 00:00:00'")).coalesce(1).write.mode("append").parquet(path)
    assert TS.telemetry_scan(spark, path, schema=schema, tolerant=True, columns=["id", "a"]).count() == 100
    assert [r.reason for r in TS.skipped_files(spark, path, schema, ["id", "a"]).collect()] == ["no value of a"]


def test_a_folder_of_mixed_schemas_is_rejected_with_all_offenders(spark, tmpdir_path):
    path = _folder(spark, tmpdir_path, "mixed")
    for _ in range(2):
        spark.range(3).select("id", F.lit("x").alias("b"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("timestamp")).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(LK.SchemaError) as e:
        LK.load_folder(spark, path, os.path.join(tmpdir_path, "out"))
    assert str(e.value).count("b: string") == 2


MOMENT = dt.datetime(2024, 1, 1)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("kl"), st.integers(0, 400), st.integers(-5, 300)), max_size=14), st.lists(st.tuples(st.sampled_from("klm"), st.integers(0, 700)), max_size=25))
def test_interval_union_keeps_each_point_once(spark, intervals, points):
    at = lambda m: MOMENT + dt.timedelta(minutes=m)
    iv = spark.createDataFrame([(k, at(s), at(s + n)) for k, s, n in intervals], "k string, start timestamp_ntz, end timestamp_ntz")
    pt = spark.createDataFrame([(i, k, at(t)) for i, (k, t) in enumerate(points)], "id int, k string, t timestamp_ntz")
    got = sorted(r.id for r in interval_union_filter(pt, iv, point_ts="t", keys=["k"]).collect())
    assert got == [i for i, (k, t) in enumerate(points) if any(k == j and s <= t <= s + n for j, s, n in intervals)]


def test_interval_union_has_one_candidate_row_per_point(spark):
    """The join of points and islands gives each point at most one row, at any number of intervals."""
    for sf in (SF, "/root/testdata/sf0.01"):
        df = E.queries()["d5_interval_union_filter"](spark, sf)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "exists" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("ab\\,= ", min_size=1, max_size=6), st.text("xy\\,= ", min_size=1, max_size=6)), min_size=1, max_size=6))
def test_tags_round_trip(spark, tags):
    names = [f"t{i}" for i in range(len(tags))]
    df = spark.createDataFrame([tuple(a + b for a, b in tags)], ", ".join(f"{n} string" for n in names)).withColumn("v", F.lit(1))
    line = df.select(FM.render_line_protocol(df, "m", names, {"v": "int"}).alias("line"))
    got = FM.parse_line_protocol(line).collect()
    assert [r.tags for r in got] == [{n: a + b for n, (a, b) in zip(names, tags)}]


def test_energy_plan_reads_and_shuffles_the_rows_once(spark):
    df = E.queries()["i3_integrate_power_by_host"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall("Scan parquet", plan)) == 1 and "SortAggregate" not in plan


def test_pivot_and_iterations_lose_nothing(spark):
    from wattspark.operators import benchreport as B
    from wattspark.sources import textlogs as TL
    stats = spark.createDataFrame([("x", 8, c, float(c)) for c in (4, 8, 12, 16, 18)], "db string, ram int, cpus int, mean double")
    assert B.pivot_mean(stats).columns == ["db", "ram", "cpus_4", "cpus_8", "cpus_12", "cpus_16", "cpus_18"]
    lines = spark.createDataFrame([("/x/influx_load_ram8Gi_cores4_iter3000000000.log", 1, "loaded (mean rate 1,234.50 rows/sec)")], "path string, line_no long, line string")
    r = TL.parse_tsdb_load_logs(lines).first()
    assert (r.iter, r.rows_per_sec, r.unit) == (3_000_000_000, 1234.5, "rows/sec")
