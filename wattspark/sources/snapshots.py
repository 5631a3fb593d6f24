"""Snapshot tables: a log of immutable manifests over immutable data files.

    <root>/data/<load>/part-*.parquet     rows, written by Spark, never changed
    <root>/manifest/<load>/part-*.parquet one row per data file: path, rows, zone maps, Bloom filter
    <root>/sources/<load>/part-*.parquet  rows per source file of the load
    <root>/log/<version>.json             the snapshot: operation, parent, schema, its loads, totals

A load writes its files first and is published by one rename of its log entry, which fails if that
version exists. So readers see a whole snapshot or the one before, a load that dies leaves files that no snapshot
names, and of two writers one wins: an append then takes the newer snapshot as its parent and tries again, a replace
or a rollback raises :class:`Conflict`. Old snapshots stay readable by version or time until ``vacuum``.

Zone maps (least and greatest value and nulls of each column, per file) and a Bloom filter of the named
columns are made in one pass over the files of a load. ``scan`` asks them which files can hold rows of
a range or of given values, and reads those with the exact filter on top: Parquet's own statistics
prune within the files. What reaches the driver is the log entry and the paths that are read, as for any scan.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: words of 64 bits and bits set per value in a file's Bloom filter
WORDS, HASHES = 256, 4
#: columns of these types get least and greatest values
ZONED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)


class Conflict(RuntimeError):
    """Another writer published a snapshot in between."""


class TableExists(ValueError):
    pass


class NoTable(ValueError):
    pass


class SnapshotTable:
    """A table at ``root`` (any file system that Spark writes). ``bloom``: columns with a Bloom filter per file;
    ``order``: columns by which the rows of a load are range-partitioned and sorted, so that zones are narrow."""

    def __init__(self, spark: SparkSession, root: str, bloom: Sequence[str] = (), order: Sequence[str] = ()):
        self.spark, self.root, self.bloom, self.order = spark, root.rstrip("/"), list(bloom), list(order)
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # ------------------------------------------------------------------ the log
    def _path(self, p: str):
        return self._hadoop.Path(p)

    def versions(self) -> list[int]:
        """Published versions, ascending."""
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, version: int | None = None, as_of: dt.datetime | None = None) -> dict:
        """The log entry of a version, of the newest one, or of the newest not after ``as_of`` (UTC)."""
        have = self.versions()
        if version is None and as_of is not None:
            limit = as_of.replace(tzinfo=as_of.tzinfo or dt.timezone.utc).timestamp() * 1000
            version = next((v for v in reversed(have) if self._read(v)["time_ms"] <= limit), None)
            if version is None:
                raise NoTable(f"{self.root} has no snapshot at {as_of}")
        if not have or (version is not None and version not in have):
            raise NoTable(f"{self.root} has no snapshot" + ("" if version is None else f" {version}"))
        return self._read(have[-1] if version is None else version)

    def _read(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/log/{version:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, entry: dict) -> None:
        """Rename of a finished file: it appears whole, or not at all if the version is taken."""
        final = self._path(f"{self.root}/log/{entry['version']:020d}.json")
        draft = self._path(f"{self.root}/log/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(final), options)
        except Exception as e:  # noqa: BLE001 - the JVM's own exception type
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e) or self._fs.exists(final):
                raise Conflict(f"version {entry['version']} of {self.root} was published by another writer") from None
            raise

    # ------------------------------------------------------------------ writing
    def _write(self, df: DataFrame, source: Column | None) -> dict:
        """Writes data, manifest and sources of a load; nothing refers to them yet."""
        load = uuid.uuid4().hex
        rows = df.withColumn("source_file", source) if source is not None else df
        if self.order:
            rows = rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order)
        data = f"{self.root}/data/{load}"
        rows.write.parquet(data)
        stored = self.spark.read.schema(rows.schema).parquet(data)
        describe(stored, self.bloom).write.parquet(f"{self.root}/manifest/{load}")
        if "source_file" in rows.columns:
            per = stored.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
            per.write.parquet(f"{self.root}/sources/{load}")
        sums = self.spark.read.parquet(f"{self.root}/manifest/{load}").agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        return {"load": load, "files": sums[0], "rows": sums[1], "schema": rows.schema.json(), "sources": "source_file" in rows.columns}

    def load(self, df: DataFrame, mode: str = "append", source: Column | None = None, token: str | None = None, retries: int = 20) -> int:
        """Publishes the rows of ``df`` and returns the version. ``mode``: create (fails on a table), skip (leaves a table
        as it is), replace, append. ``source``: the file a row comes from, kept as ``source_file``.

        A load with a ``token`` that the present snapshot's history has already is not repeated (a replayed batch).
        """
        if mode not in ("create", "skip", "replace", "append"):
            raise ValueError(f"unknown mode {mode}")
        base = self._newest()
        if base is not None:
            if mode == "create":
                raise TableExists(self.root)
            if mode == "skip" or token is not None and token in base["tokens"]:
                return base["version"]
            if mode == "append":
                self._same_columns(base, df, source)
        part = self._write(df, source)
        for _ in range(retries):
            try:
                keep = base["loads"] if base is not None and mode == "append" else []
                return self._commit(base, mode, [*keep, part], part, token)
            except Conflict:
                now = self._newest()
                if mode == "skip":
                    return now["version"]
                if mode == "create":
                    raise TableExists(self.root) from None
                if mode == "replace":
                    raise
                if token is not None and token in now["tokens"]:
                    return now["version"]
                self._same_columns(now, df, source)
                base = now
                time.sleep(0.05)
        raise Conflict(f"{self.root}: no room for version after {retries} tries")

    def _newest(self) -> dict | None:
        have = self.versions()
        return self._read(have[-1]) if have else None

    def _same_columns(self, base: dict, df: DataFrame, source: Column | None) -> None:
        if not base["loads"]:
            return
        old = T.StructType.fromJson(json.loads(base["loads"][-1]["schema"]))
        new = df.schema if source is None or "source_file" in df.columns else df.schema.add("source_file", "string")
        have, want = {f.name: f.dataType for f in new}, {f.name: f.dataType for f in old}
        if have != want:
            bad = sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
            raise ValueError("columns differ from the table's: " + ", ".join(bad))

    def _commit(self, base: dict | None, operation: str, loads: list[dict], part: dict | None, token: str | None = None) -> int:
        version = base["version"] + 1 if base is not None else 1
        tokens = ([] if base is None or operation in ("replace", "create") else base["tokens"]) + ([token] if token else [])
        self._publish({"version": version, "parent": base and base["version"], "operation": operation, "time_ms": int(time.time() * 1000),
                       "load": part and part["load"], "added_rows": part["rows"] if part else 0, "added_files": part["files"] if part else 0,
                       "rows": sum(x["rows"] for x in loads), "files": sum(x["files"] for x in loads), "loads": loads, "tokens": tokens})
        return version

    def rollback(self, version: int) -> int:
        """A new snapshot with the files of an old one."""
        old, base = self.entry(version), self.entry()
        return self._commit(base | {"tokens": old["tokens"]}, "rollback", old["loads"], None)

    def compact(self, df: DataFrame | None = None) -> int:
        """A new snapshot with the same rows (or those of ``df``, made from the newest snapshot) in new files; tokens stay."""
        base = self.entry()
        rows = self.read(base["version"]) if df is None else df
        part = self._write(rows, None)
        return self._commit(base, "compact", [part], part)

    def read_loads(self, loads: Sequence[str]) -> DataFrame:
        """Rows of the named loads of the newest snapshot."""
        kept = [x for x in self.entry()["loads"] if x["load"] in set(loads)]
        schema = T.StructType.fromJson(json.loads(kept[-1]["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{x['load']}" for x in kept])

    def replace_loads(self, loads: Sequence[str], df: DataFrame, retries: int = 20) -> int:
        """A new snapshot in which one load with the rows of ``df`` stands for the named loads. Loads appended in the
        meantime stay; if one of the named ones is gone, :class:`Conflict` is raised."""
        gone, part = set(loads), self._write(df, None)
        for _ in range(retries):
            base = self.entry()
            if not gone <= {x["load"] for x in base["loads"]}:
                raise Conflict(f"loads of {self.root} were replaced by another writer")
            try:
                at = next(i for i, x in enumerate(base["loads"]) if x["load"] in gone)
                kept = [[x for x in side if x["load"] not in gone] for side in (base["loads"][:at], base["loads"][at:])]
                return self._commit(base, "compact", [*kept[0], part, *kept[1]], part)
            except Conflict:
                time.sleep(0.05)
        raise Conflict(f"{self.root}: no room for version after {retries} tries")

    def vacuum(self, keep: int = 1) -> int:
        """Removes log entries but the newest ``keep``, and loads that no remaining one names; returns how many loads.
        Not to be run while a load is written."""
        have = self.versions()
        for v in have[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{v:020d}.json"), False)
        used = {x["load"] for v in have[-keep:] for x in self._read(v)["loads"]}
        gone = set()
        for kind in ("data", "manifest", "sources"):
            folder = self._path(f"{self.root}/{kind}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if s.getPath().getName() not in used:
                    self._fs.delete(s.getPath(), True)
                    gone.add(s.getPath().getName())
        return len(gone)

    # ------------------------------------------------------------------ reading
    def schema(self, version: int | None = None) -> T.StructType:
        loads = self.entry(version)["loads"]
        return T.StructType.fromJson(json.loads(loads[-1]["schema"])) if loads else T.StructType()

    def _tables(self, kind: str, entry: dict) -> DataFrame | None:
        paths = [f"{self.root}/{kind}/{x['load']}" for x in entry["loads"] if kind != "sources" or x["sources"]]
        return self.spark.read.parquet(*paths) if paths else None

    def files(self, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """The manifest of a snapshot: ``path, rows, zones, blooms``."""
        entry = self.entry(version, as_of)
        return self._tables("manifest", entry)

    def read(self, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """All rows of a snapshot."""
        entry = self.entry(version, as_of)
        schema = T.StructType.fromJson(json.loads(entry["loads"][-1]["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{x['load']}" for x in entry["loads"]])

    def plan(self, ranges: dict[str, tuple] | None = None, values: dict[str, Sequence] | None = None, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """The part of the manifest whose files may hold rows with every column of ``ranges`` in [low, high) (None: open)
        and every column of ``values`` equal to one of its values."""
        files = self.files(version, as_of)
        return files.where(_may_hold(files, ranges or {}, values or {}))

    def scan(self, ranges: dict[str, tuple] | None = None, values: dict[str, Sequence] | None = None, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """Rows with every column of ``ranges`` in [low, high) and every column of ``values`` equal to one of its
        values; only files that ``plan`` names are read."""
        version = self.entry(version, as_of)["version"]  # one snapshot for plan and rows
        paths = [r.path for r in self.plan(ranges, values, version).select("path").collect()]
        schema = self.schema(version)
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(_exact(ranges or {}, values or {}))

    def history(self) -> DataFrame:
        """``version, parent, operation, committed, rows, files, added_rows, added_files`` per snapshot."""
        rows = [(e["version"], e["parent"], e["operation"], dt.datetime.fromtimestamp(e["time_ms"] / 1000, dt.timezone.utc), e["rows"], e["files"], e["added_rows"], e["added_files"])
                for e in map(self._read, self.versions())]
        return self.spark.createDataFrame(rows, "version long, parent long, operation string, committed timestamp, rows long, files long, added_rows long, added_files long")

    def lineage(self, version: int | None = None) -> DataFrame:
        """``source_file, rows, version`` of a snapshot: what each source file brought, and the snapshot that published it."""
        entry = self.entry(version)
        first = {}
        for v in self.versions():
            for x in self._read(v)["loads"]:
                first.setdefault(x["load"], v)
        out = None
        for x in entry["loads"]:
            if x["sources"]:
                part = self.spark.read.parquet(f"{self.root}/sources/{x['load']}").withColumn("version", F.lit(first[x["load"]]).cast("long"))
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "source_file string, rows long, version long")


# ------------------------------------------------------------------ zone maps and Bloom filters
def _bits(value: Column) -> list[Column]:
    """The places of a value in a Bloom filter: two hashes, combined."""
    one, two = F.xxhash64(value), F.hash(value).cast("long")
    return [F.pmod(F.pmod(one, F.lit(WORDS * 64)) + F.lit(i) * F.pmod(two, F.lit(WORDS * 64)), F.lit(WORDS * 64)) for i in range(HASHES)]


def describe(stored: DataFrame, bloom: Sequence[str] = ()) -> DataFrame:
    """One row per Parquet file of ``stored``: ``path, rows, zones`` (struct per column: low, high, nulls) and ``blooms``
    (array of words per named column)."""
    path = F.col("_metadata.file_path")
    zoned = [f.name for f in stored.schema if isinstance(f.dataType, ZONED)]
    per = stored.select(path.alias("path"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(zoned)]).groupBy("path").agg(
        F.count(F.lit(1)).alias("rows"), *[x for i in range(len(zoned)) for x in (F.min(f"v{i}").alias(f"low{i}"), F.max(f"v{i}").alias(f"high{i}"), F.count(f"v{i}").alias(f"n{i}"))])
    zones = F.struct(*[F.struct(F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"), (F.col("rows") - F.col(f"n{i}")).alias("nulls")).alias(c) for i, c in enumerate(zoned)])
    out = per.select("path", "rows", zones.alias("zones"))
    for c in bloom:
        values = stored.select(path.alias("path"), F.col(c).alias("v")).where("v IS NOT NULL").distinct()
        bits = values.select("path", F.explode(F.array(*_bits(F.col("v")))).alias("bit"))
        words = bits.groupBy("path", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        filters = words.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
        out = out.join(filters.select("path", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(0).cast("long"))).alias(f"bloom_{c}")), "path", "left")
    return out.select("path", "rows", "zones", F.struct(*[F.col(f"bloom_{c}").alias(c) for c in bloom]).alias("blooms")) if bloom else out


def _literal(v) -> Column:
    # a wall-clock time stays one: telemetry has times without a zone
    return v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz") if isinstance(v, dt.datetime) and v.tzinfo is None else F.lit(v)


def _may_hold(files: DataFrame, ranges: dict, values: dict) -> Column:
    zones = {f.name: f.dataType for f in files.schema["zones"].dataType}
    filters = {f.name for f in files.schema["blooms"].dataType} if "blooms" in files.columns else set()
    ok = F.lit(True)
    for c, (low, high) in ranges.items():
        if c in zones:  # a column that has no zone rules out nothing
            z = F.col("zones").getField(c)
            ok = ok & (F.coalesce(z["high"] >= _literal(low), F.lit(False)) if low is not None else F.lit(True))
            ok = ok & (F.coalesce(z["low"] < _literal(high), F.lit(False)) if high is not None else F.lit(True))
    for c, some in values.items():
        any_of = F.lit(False)
        for v in some:
            one = F.lit(True)
            if c in zones:
                z = F.col("zones").getField(c)
                kind = zones[c]["low"].dataType
                one = F.coalesce(_literal(v).cast(kind).between(z["low"], z["high"]), F.lit(False))
                if c in filters:  # hashes depend on the type
                    for b in _bits(_literal(v).cast(kind)):
                        word = F.get(F.col("blooms").getField(c), F.floor(b / 64).cast("int"))
                        one = one & (F.getbit(word, (b % 64).cast("int")) == 1)
            any_of = any_of | one
        ok = ok & any_of
    return ok


def _exact(ranges: dict, values: dict) -> Column:
    ok = F.lit(True)
    for c, (low, high) in ranges.items():
        if low is not None:
            ok = ok & (F.col(c) >= _literal(low))
        if high is not None:
            ok = ok & (F.col(c) < _literal(high))
    for c, some in values.items():
        ok = ok & F.col(c).isin([_literal(v) for v in some])
    return ok
