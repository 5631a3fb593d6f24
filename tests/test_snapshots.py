"""Snapshot tables: atomic publishing, load modes, reading as of, rollback, conflicts, data skipping."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from wattspark.sources import snapshots as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "timestamp timestamp_ntz, host string, value double"


def _rows(spark, n=400, start=0, hosts=40):
    rows = [(T0 + dt.timedelta(minutes=start + i), f"h{(start + i) // 10 % hosts}", float(i) if i % 7 else None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _table(spark, root, **kw):
    return S.SnapshotTable(spark, os.path.join(root, "t"), bloom=["host"], order=["timestamp"], **kw)


def _set(df):
    return sorted(map(tuple, df.select("timestamp", "host", "value").collect()), key=repr)


def test_modes_versions_and_time_travel(spark, tmpdir_path):
    t = _table(spark, tmpdir_path)
    a, b = _rows(spark, 50), _rows(spark, 30, 1000)
    with pytest.raises(S.NoTable):
        t.read()
    assert t.load(a, "create") == 1
    with pytest.raises(S.TableExists):
        t.load(b, "create")
    assert t.load(b, "skip") == 1 and t.read().count() == 50
    before = dt.datetime.now(dt.timezone.utc)
    assert t.load(b, "append") == 2
    assert t.load(b, "replace") == 3
    assert _set(t.read(1)) == _set(a) and _set(t.read(2)) == _set(a.union(b)) and _set(t.read()) == _set(b)
    assert _set(t.read(as_of=before)) == _set(a)
    with pytest.raises(S.NoTable):
        t.read(as_of=T0)
    with pytest.raises(S.NoTable):
        t.read(9)
    assert t.rollback(2) == 4 and _set(t.read()) == _set(a.union(b))
    got = [(r.version, r.parent, r.operation, r.rows, r.added_rows) for r in t.history().orderBy("version").collect()]
    assert got == [(1, None, "create", 50, 50), (2, 1, "append", 80, 30), (3, 2, "replace", 30, 30), (4, 3, "rollback", 80, 0)]


def test_a_load_that_dies_leaves_the_old_snapshot(spark, tmpdir_path):
    t = _table(spark, tmpdir_path)
    t.load(_rows(spark, 20), "create")
    bad = _rows(spark, 2000, 500).withColumn("value", F.when(F.minute("timestamp") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("value")).cast("double"))
    for mode in ("append", "replace"):
        with pytest.raises(Exception, match="lost"):
            t.load(bad, mode)
        assert t.versions() == [1] and t.read().count() == 20
    # data written, but not published
    part = t._write(_rows(spark, 5), None)
    assert t.read().count() == 20
    assert t.vacuum() >= 1
    assert not os.path.exists(f"{t.root}/data/{part['load']}") and t.read().count() == 20


def test_concurrent_writers(spark, tmpdir_path, monkeypatch):
    t, other = _table(spark, tmpdir_path), _table(spark, tmpdir_path)
    t.load(_rows(spark, 10), "create")

    def meanwhile(mode, n):  # another writer publishes between this one's write and its commit
        plain = t._write

        def write(df, source):
            part = plain(df, source)
            monkeypatch.setattr(t, "_write", plain)
            other.load(_rows(spark, n, 5000), mode)
            return part
        monkeypatch.setattr(t, "_write", write)

    meanwhile("append", 3)
    assert t.load(_rows(spark, 4, 100), "append") == 3 and t.read().count() == 17  # neither is lost
    meanwhile("append", 1)
    with pytest.raises(S.Conflict):
        t.load(_rows(spark, 4), "replace")
    assert t.read().count() == 18
    entry = t.entry()
    with pytest.raises(S.Conflict):  # the same version twice
        t._publish(entry)
    assert t.entry() == entry


def test_replayed_loads_and_other_columns(spark, tmpdir_path):
    t = _table(spark, tmpdir_path)
    t.load(_rows(spark, 5), token="batch-0")
    t.load(_rows(spark, 5, 50), token="batch-1")
    assert t.load(_rows(spark, 5, 50), token="batch-1") == 2 and t.read().count() == 10
    t.compact()
    assert t.load(_rows(spark, 5), token="batch-0") == 3 and t.read().count() == 10
    with pytest.raises(ValueError, match="extra"):
        t.load(_rows(spark, 5).withColumn("extra", F.lit(1)))
    with pytest.raises(ValueError, match="value"):
        t.load(_rows(spark, 5).withColumn("value", F.lit("x")))


def test_lineage_names_the_snapshot_of_each_source(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "src")
    t = _table(spark, tmpdir_path)
    for k, n in enumerate((30, 20)):
        _rows(spark, n, 100 * k).coalesce(1).write.parquet(f"{src}{k}")
        t.load(spark.read.parquet(f"{src}{k}"), source=F.col("_metadata.file_name"))
    got = [(r.rows, r.version) for r in t.lineage().orderBy("version").collect()]
    assert got == [(30, 1), (20, 2)] and t.lineage(1).count() == 1
    assert t.read().where("source_file LIKE 'part-%'").count() == 50


def test_scans_plan_by_zones_and_filters(spark, tmpdir_path):
    t = _table(spark, tmpdir_path)
    for k in range(8):  # a load per stretch of time
        t.load(_rows(spark, 200, 200 * k, hosts=160))
    all_rows = t.read()
    files = t.files().count()
    assert files >= 8 and t.files().agg(F.sum("rows")).first()[0] == 1600
    lo, hi = T0 + dt.timedelta(minutes=450), T0 + dt.timedelta(minutes=500)
    cases = [({"timestamp": (lo, hi)}, {}), ({"timestamp": (lo, None)}, {}), ({"timestamp": (None, lo)}, {}), ({}, {"host": ["h77"]}), ({}, {"host": ["h1", "h159"]}), ({"value": (390.0, None)}, {}),
             ({"timestamp": (lo, hi)}, {"host": ["h46"]}), ({}, {"host": ["nobody"]}), ({}, {"host": []}), ({"timestamp": (hi, lo)}, {})]
    for ranges, values in cases:
        want = all_rows.where(S._exact(ranges, values))
        assert _set(t.scan(ranges, values)) == _set(want), (ranges, values)
    assert t.plan({"timestamp": (lo, hi)}).count() <= 2 < files
    assert t.plan(values={"host": ["h77"]}).count() <= 2
    assert t.plan(values={"host": ["nobody"]}).count() == 0
    assert len(t.scan({"timestamp": (lo, hi)}).inputFiles()) <= 2
    # zone maps see nulls, and hosts between least and greatest that the filter alone can exclude
    z = t.files().select("zones.value.nulls", "rows").collect()
    assert sum(r.nulls for r in z) == all_rows.where("value IS NULL").count()


def test_empty_loads(spark, tmpdir_path):
    t = _table(spark, tmpdir_path)
    assert t.load(_rows(spark, 5).where("false"), "create") == 1
    assert t.read().count() == 0 and t.scan({"timestamp": (T0, None)}).count() == 0
    assert t.load(_rows(spark, 5)) == 2 and t.scan(values={"host": ["h0"]}).count() == 5
