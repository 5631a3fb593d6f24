"""Flat day files ``<table>_<day>_<next day>.parquet`` as a Spark data source, ``dayfiles``.

The writer commits in two phases. Tasks write below a staging folder of their own job; when all of them are
done, the driver moves the files of the attempts that count to their names and appends one entry to the
folder's log. A failed task or job leaves no day file: what it staged is deleted. The batch reader takes the files that
the log names (all of them where a folder has no log), leaves out those whose day range lies outside the filters on the time column, and
skips row groups by them. A driver that dies between the moves and the log leaves files that this reader doesn't count (a plain Parquet scan would). The stream reader's offset is the number of a load: a batch holds the files
of whole loads, each once.

Reader and writer run in Python, so they need a file system that pyarrow knows (local or mounted paths, hdfs, s3, gs). One writer at a
time: two at once could take the same number in the log.

Defined results: a row without a time has no day and fails the job; an empty frame writes no day file but counts as a load; days that
are written again get further files (``<table>-1_<day>_..``); ``overwrite`` deletes the earlier day files of the table after its own stand in the log.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from wattspark.sources.telemetry import FILE_RANGE

LOG = "_log"

# executors need not have this package: the classes travel with the plan
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Folder:
    """A folder of day files and its log."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs
        self.path = path
        if "://" in path and not path.startswith("file:"):
            try:
                self.fs, self.root = fs.FileSystem.from_uri(path)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
                raise ValueError(f"day files need a file system that pyarrow knows: {path}") from e
        else:
            self.fs, self.root = fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)
        self.root = self.root.rstrip("/")

    def names(self, sub: str = "") -> list[str]:
        from pyarrow.fs import FileSelector
        return sorted(f.base_name for f in self.fs.get_file_info(FileSelector(self.root + sub, allow_not_found=True)) if f.is_file)

    def loads(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.names(f"/{LOG}") if n.endswith(".json")]

    def load(self, number: int) -> dict:
        with self.fs.open_input_stream(f"{self.root}/{LOG}/{number:010d}.json") as f:
            return json.loads(f.read())

    def write_load(self, entry: dict) -> None:
        number = max(self.loads(), default=0) + 1
        self.fs.create_dir(f"{self.root}/{LOG}")
        draft = f"{self.root}/{LOG}/{number:010d}.draft"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(draft, f"{self.root}/{LOG}/{number:010d}.json")

    def files(self) -> list[str]:
        """Day files that count."""
        numbers = self.loads()
        if not numbers:
            return [n for n in self.names() if n.endswith(".parquet")]
        files: set[str] = set()
        for n in numbers:
            entry = self.load(n)
            files = files - set(entry["removed"]) | set(entry["added"])
        return sorted(files)

    def schema(self):
        import pyarrow.parquet as pq
        files = self.files()
        if not files:
            raise ValueError(f"no day files under {self.path}: give a schema")
        with self.fs.open_input_file(f"{self.root}/{files[0]}") as f:
            return from_arrow_schema(pq.read_schema(f), prefer_timestamp_ntz=True)

    def batches(self, name: str, schema, bounds: list[tuple[str, dt.datetime]] = (), ts_col: str = ""):
        """Record batches of one file; row groups outside ``bounds`` are not read."""
        import pyarrow.dataset as ds
        import pyarrow as pa
        data = ds.dataset(f"{self.root}/{name}", filesystem=self.fs, format="parquet")
        keep = None
        for op, value in bounds:
            kind = data.schema.field(ts_col).type
            edge = pa.scalar(value.replace(tzinfo=dt.timezone.utc) if kind.tz else value, kind)
            one = ds.field(ts_col) >= edge if op == "from" else ds.field(ts_col) <= edge
            keep = one if keep is None else keep & one
        want = to_arrow_schema(schema)
        for b in data.scanner(columns=want.names, filter=keep, batch_size=16384).to_batches():
            if b.num_rows:
                yield b.cast(want)


def _utc(value) -> dt.datetime:
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def _day_range(name: str) -> tuple[dt.datetime, dt.datetime] | None:
    m = re.search(FILE_RANGE, name)
    return m and tuple(_utc(dt.datetime.fromisoformat(x)) for x in m.groups())


class DayReader(DataSourceReader):
    def __init__(self, path, schema, ts_col):
        self.path, self.want, self.ts_col, self.bounds = path, schema, ts_col, []

    def pushFilters(self, filters):
        """Bounds of the time column choose files and row groups; Spark applies every filter again."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.ts_col,) and isinstance(getattr(f, "value", None), dt.datetime):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.bounds.append(("from", _utc(f.value)))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.bounds.append(("to", _utc(f.value)))
            yield f

    def planned(self) -> list[str]:
        """Files whose days meet the bounds; a name without days is always read."""
        def meets(name):
            days = _day_range(name)
            return not days or all(days[1] >= v if op == "from" else days[0] <= v for op, v in self.bounds)

        return [n for n in Folder(self.path).files() if meets(n)]

    def partitions(self):
        return [InputPartition(n) for n in self.planned()]

    def read(self, partition):
        if partition is not None:
            yield from Folder(self.path).batches(partition.value, self.want, self.bounds, self.ts_col)


class DayStream(DataSourceStreamReader):
    def __init__(self, path, schema):
        self.path, self.want = path, schema

    def initialOffset(self):
        return {"load": 0}

    def latestOffset(self):
        return {"load": max(Folder(self.path).loads(), default=0)}

    def partitions(self, start, end):
        folder = Folder(self.path)
        return [InputPartition(n) for load in range(start["load"] + 1, end["load"] + 1) for n in folder.load(load)["added"]]

    def read(self, partition):
        yield from Folder(self.path).batches(partition.value, self.want)


@dataclass
class Written(WriterCommitMessage):
    """Staged files of a task: (day, file)."""
    files: list


class DayWriter(DataSourceArrowWriter):
    def __init__(self, path, table, ts_col, overwrite):
        self.path, self.table, self.ts_col, self.overwrite = path, table, ts_col, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator):
        """One staged file per run of rows of a day, written batch by batch; a failed attempt's files are never named."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        folder, files, day, out = Folder(self.path), [], None, None
        folder.fs.create_dir(f"{folder.root}/{self.staging}")
        try:
            for b in iterator:
                times = b.column(self.ts_col)
                if times.null_count:
                    raise ValueError(f"rows without {self.ts_col} have no day file")
                days = times.cast(pa.date32(), safe=False).cast(pa.int32()).to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(days)) + 1).tolist(), len(days)]
                for lo, hi in zip(edges, edges[1:]):
                    if hi > lo:
                        if days[lo] != day:
                            if out:
                                out.close()
                            day = int(days[lo])
                            name = f"{self.staging}/{uuid.uuid4().hex}"
                            out = pq.ParquetWriter(f"{folder.root}/{name}", b.schema, filesystem=folder.fs, compression="zstd")
                            files.append((day, name))
                        out.write_batch(b.slice(lo, hi - lo))
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages):
        folder = Folder(self.path)
        before = folder.files()
        taken, placed = set(folder.names()), []
        try:
            for day, staged in sorted(f for m in messages if m for f in m.files):
                first = dt.date(1970, 1, 1) + dt.timedelta(days=day)
                days = f"{first}_{first + dt.timedelta(days=1)}.parquet"
                name, k = f"{self.table}_{days}", 0
                while name in taken:
                    k += 1
                    name = f"{self.table}-{k}_{days}"
                folder.fs.move(f"{folder.root}/{staged}", f"{folder.root}/{name}")
                taken.add(name)
                placed.append(name)
            removed = [n for n in before if re.fullmatch(re.escape(self.table) + r"(-\d+)?" + FILE_RANGE, n)] if self.overwrite else []
            # a folder that was filled without a log keeps what it had
            kept = [] if folder.loads() else [n for n in before if n not in removed]
            folder.write_load({"added": kept + placed, "removed": removed})
        except Exception:
            for name in placed:
                folder.fs.delete_file(f"{folder.root}/{name}")
            self.abort(messages)
            raise
        for name in removed:
            folder.fs.delete_file(f"{folder.root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        """Deletes what was staged and not named."""
        from pyarrow.fs import FileType
        folder = Folder(self.path)
        staging = f"{folder.root}/{self.staging}"
        if folder.fs.get_file_info(staging).type != FileType.NotFound:
            folder.fs.delete_dir(staging)


class DayFiles(DataSource):
    """Options: the folder (``path``), ``ts_col`` (``timestamp``) and, to write, ``table`` (the folder's name)."""

    @classmethod
    def name(cls):
        return "dayfiles"

    def schema(self):
        return Folder(self.options["path"]).schema()

    def _ts_col(self):
        return self.options.get("ts_col", "timestamp")

    def reader(self, schema):
        return DayReader(self.options["path"], schema, self._ts_col())

    def streamReader(self, schema):
        return DayStream(self.options["path"], schema)

    def writer(self, schema, overwrite):
        path = self.options["path"]
        return DayWriter(path, self.options.get("table") or path.rstrip("/").rsplit("/", 1)[-1], self._ts_col(), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("dayfiles")`` known to the session and let Spark hand filters to it."""
    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_day_files(df: DataFrame, path: str, table: str, ts_col: str = "timestamp", mode: str = "append") -> None:
    """``df`` as flat day files. Each task holds one stretch of time, so most days are one file and
    a very large day is several."""
    register(df.sparkSession)
    (df.repartitionByRange(F.col(ts_col)).sortWithinPartitions(ts_col)
       .write.format("dayfiles").option("table", table).option("ts_col", ts_col).mode(mode).save(path))


def read_day_files(spark: SparkSession, path: str, ts_col: str = "timestamp", schema=None) -> DataFrame:
    """A2: the day files of a folder; filters on ``ts_col`` choose the files."""
    register(spark)
    r = spark.read.format("dayfiles").option("ts_col", ts_col)
    return (r.schema(schema) if schema is not None else r).load(path)


def stream_day_files(spark: SparkSession, path: str, schema) -> DataFrame:
    """The loads of a folder as a stream, each file once."""
    register(spark)
    return spark.readStream.format("dayfiles").schema(schema).load(path)
