"""Schema validation, day-partitioned loads, modes, scans with pruning, checksums."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F, types as T

from wattspark.sources import lake as LK, telemetry as TS

T0 = dt.datetime(2024, 1, 1)


def test_validate_schema_accepts_all_listed_types():
    s = T.StructType([T.StructField(n, ty) for n, ty in [
        ("timestamp", T.TimestampType()), ("b", T.BooleanType()), ("i8", T.ByteType()), ("i16", T.ShortType()),
        ("i32", T.IntegerType()), ("i64", T.LongType()), ("f", T.FloatType()), ("d", T.DoubleType()),
        ("s", T.StringType()), ("dt", T.DateType()), ("ntz", T.TimestampNTZType())]])
    m = LK.validate_schema(s)
    assert m["timestamp"] == "timestamptz" and m["ntz"] == "timestamp" and m["i8"] == "integer"


def test_validate_schema_lists_all_offenders():
    s = T.StructType([T.StructField("timestamp", T.TimestampNTZType()), T.StructField("d", T.DecimalType(10, 2)),
                      T.StructField("a", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.StringType(), T.LongType())),
                      T.StructField("bin", T.BinaryType())])
    with pytest.raises(LK.SchemaError) as e:
        LK.validate_schema(s)
    for name in ("d:", "a:", "m:", "bin:"):
        assert name in str(e.value)


@pytest.mark.parametrize("schema,msg", [
    (T.StructType([T.StructField("ts", T.TimestampType())]), "missing"),
    (T.StructType([T.StructField("timestamp", T.StringType())]), "must be a timestamp")])
def test_validate_schema_timestamp_rules(schema, msg):
    with pytest.raises(LK.SchemaError, match=msg):
        LK.validate_schema(schema)


def _src(spark, root):
    rows = [(T0 + dt.timedelta(hours=6 * i), f"h{i % 3}", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, host string, value double")
    src = os.path.join(root, "src")
    for day in range(3):
        d0 = T0 + dt.timedelta(days=day)
        part = df.where((F.col("timestamp") >= d0) & (F.col("timestamp") < d0 + dt.timedelta(days=1)))
        name = f"ipmi_power_{d0.date()}_{(d0 + dt.timedelta(days=1)).date()}.parquet"
        part.coalesce(1).write.parquet(os.path.join(root, "tmp", name))
        f = [x for x in os.listdir(os.path.join(root, "tmp", name)) if x.endswith(".parquet")][0]
        os.makedirs(src, exist_ok=True)
        os.replace(os.path.join(root, "tmp", name, f), os.path.join(src, name))
    return src


def test_load_modes_lineage_and_report(spark, tmpdir_path):
    src = _src(spark, tmpdir_path)
    dest = os.path.join(tmpdir_path, "lake")
    LK.load_folder(spark, src, dest, mode="create")
    t = spark.read.parquet(dest)
    assert t.count() == 12
    assert {r.source_file: r.rows for r in LK.manifest(t).collect()} == {
        f"ipmi_power_2024-01-0{d}_2024-01-0{d + 1}.parquet": 4 for d in (1, 2, 3)}
    rep = LK.load_report(t).groupBy("timestamp_day").agg(F.sum("rows").alias("n")).collect()
    assert sorted((r.timestamp_day, r.n) for r in rep) == [(dt.date(2024, 1, d), 4) for d in (1, 2, 3)]
    with pytest.raises(Exception):
        LK.load_folder(spark, src, dest, mode="create")       # exists -> error
    LK.load_folder(spark, src, dest, mode="skip")             # exists -> untouched
    assert spark.read.parquet(dest).count() == 12
    LK.load_folder(spark, src, dest, mode="append")
    assert spark.read.parquet(dest).count() == 24
    LK.load_folder(spark, src, dest, mode="replace")
    assert spark.read.parquet(dest).count() == 12


def test_scan_file_pruning_and_closed_filter(spark, tmpdir_path):
    src = _src(spark, tmpdir_path)
    df = TS.telemetry_scan(spark, src, timefilter=(T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1, hours=12)),
                           columns=["timestamp", "value", "missing_col"])
    got = sorted(r.value for r in df.collect())
    assert got == [4.0, 5.0, 6.0]                              # closed both ends
    assert df.columns == ["timestamp", "value", "missing_col"]
    assert TS.telemetry_scan(spark, os.path.join(tmpdir_path, "nothing")).count() == 0


def test_lake_range_scan_prunes_partitions(spark, tmpdir_path):
    src = _src(spark, tmpdir_path)
    dest = os.path.join(tmpdir_path, "lake")
    LK.load_folder(spark, src, dest, mode="create")
    q = TS.range_half_open(spark.read.parquet(dest), T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2))
    assert sorted(r.value for r in q.collect()) == [4.0, 5.0, 6.0, 7.0]   # half-open
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "timestamp_day" in plan


def test_day_sliced_extract_one_job(spark, tmpdir_path):
    src = _src(spark, tmpdir_path)
    out = os.path.join(tmpdir_path, "extract")
    TS.day_sliced_extract(spark.read.parquet(src), out, T0, T0 + dt.timedelta(days=2), ["timestamp", "value"])
    assert sorted(d for d in os.listdir(out) if d.startswith("day=")) == ["day=2024-01-01", "day=2024-01-02"]
    assert spark.read.parquet(out).count() == 8


def test_checksum_verify(spark, tmpdir_path):
    src = _src(spark, tmpdir_path)
    files = sorted(os.listdir(src))
    import hashlib
    md5 = {f: hashlib.md5(open(os.path.join(src, f), "rb").read()).hexdigest() for f in files}
    exp = spark.createDataFrame([(files[0], md5[files[0]]), (files[1], "0" * 32), ("gone.parquet", "1" * 32)],
                                "file string, expected_md5 string")
    got = {r.file: r.status for r in LK.checksum_verify(spark, src, exp).collect()}
    assert got == {files[0]: "ok", files[1]: "mismatch", files[2]: "unexpected", "gone.parquet": "missing"}


def test_tolerant_read_skips_corrupt_file(spark, tmpdir_path):
    src = _src(spark, tmpdir_path)
    with open(os.path.join(src, "ipmi_power_2024-01-09_2024-01-10.parquet"), "wb") as f:
        f.write(b"not a parquet file")
    schema = spark.read.parquet(os.path.join(src, "ipmi_power_2024-01-01_2024-01-02.parquet")).schema
    df = TS.telemetry_scan(spark, src, schema=schema, tolerant=True)
    assert df.count() == 12
