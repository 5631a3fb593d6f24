"""Loading telemetry into a day-partitioned lake table.

The schema of the first file is validated, and every file's footer is compared with it
(read by Spark's tasks) before all files are loaded in one read. Appends record each row's
source file (``_metadata.file_name``) so a manifest is a group-by, not a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

# The accepted column types and their lake type names.
ACCEPTED = {
    T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer",
    T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string",
    T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp",
}
MODES = {"skip": "ignore", "replace": "overwrite", "create": "errorifexists", "append": "append"}


class SchemaError(ValueError):
    pass


def validate_schema(schema: T.StructType, ts_col: str = "timestamp") -> dict[str, str]:
    """Map every column to its lake type; reject the whole schema listing ALL
    unsupported columns; require a timestamp column of a timestamp type."""
    bad, out = [], {}
    for f in schema.fields:
        lt = next((v for k, v in ACCEPTED.items() if isinstance(f.dataType, k)), None)
        if lt is None:
            bad.append(f"{f.name}: {f.dataType.simpleString()}")
        else:
            out[f.name] = lt
    if bad:
        raise SchemaError("unsupported column types: " + ", ".join(bad))
    if ts_col not in out:
        raise SchemaError(f"missing required column '{ts_col}'")
    if out[ts_col] not in ("timestamp", "timestamptz"):
        raise SchemaError(f"column '{ts_col}' must be a timestamp, found {out[ts_col]}")
    return out


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """``file`` of every Parquet file under ``path``; a listing, nothing is opened."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
            .load(path).select(F.col("path").alias("file")))


FOOTER = "file string, names array<string>, schema string"


def footers(files: DataFrame) -> DataFrame:
    """``file, names, schema`` of Parquet files (``file``); names are NULL for a file that has no readable footer.

    Footers are read by Spark's tasks, by byte range, where the workers know the file system; those of other
    file systems by the driver's own Hadoop client, one after another.
    """
    def read(batches):
        import pyarrow as pa
        import pyarrow.fs as pfs
        import pyarrow.parquet as pq
        for b in batches:
            rows = []
            for name in b.column("file").to_pylist():
                try:
                    fs, inner = pfs.FileSystem.from_uri(name)
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    rows.append((name, None, ELSEWHERE))
                    continue
                try:
                    with fs.open_input_file(inner) as f:
                        schema = pq.read_schema(f)
                    rows.append((name, schema.names, ", ".join(f"{c.name}: {c.type}" for c in schema)))
                except (pa.ArrowInvalid, OSError):
                    rows.append((name, None, None))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.string())], names=["file", "names", "schema"])

    found = files.select("file").mapInArrow(read, FOOTER)
    other = [r.file for r in found.where(F.col("schema") == ELSEWHERE).select("file").toLocalIterator()]
    if not other:
        return found
    spark = files.sparkSession
    here = spark.createDataFrame([(name, *_footer_by_hadoop(spark, name)) for name in other], FOOTER)
    return found.where(F.col("schema").isNull() | (F.col("schema") != ELSEWHERE)).unionByName(here)


ELSEWHERE = "(file system unknown to the workers)"


def _footer_by_hadoop(spark: SparkSession, name: str) -> tuple[list[str] | None, str | None]:
    """Column names and schema of a file through Hadoop's file systems."""
    parquet = spark._jvm.org.apache.parquet.hadoop
    try:
        source = parquet.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration())
        reader = parquet.ParquetFileReader.open(source)
    except Exception:  # noqa: BLE001 - whatever the JVM finds wrong with the file
        return None, None
    try:
        fields = list(reader.getFooter().getFileMetaData().getSchema().getFields())
        return [f.getName() for f in fields], ", ".join(str(f.toString()) for f in fields)
    finally:
        reader.close()


def file_schemas(spark: SparkSession, path: str) -> DataFrame:
    """``file, schema`` of every Parquet file under ``path``."""
    return footers(parquet_files(spark, path)).select("file", F.coalesce("schema", F.lit("no readable footer")).alias("schema"))


def infer_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of the first file (by name) of a folder."""
    first = (spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
             .load(path).agg(F.min("path")).first()[0])
    if first is None:
        raise SchemaError(f"no parquet files under {path}")
    return spark.read.parquet(first).schema


def schema_offenders(spark: SparkSession, path: str) -> DataFrame:
    """``file, schema, usual`` of the files whose schema is not the most common one."""
    schemas = file_schemas(spark, path)
    kinds = schemas.groupBy("schema").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "schema").take(2)
    usual = kinds[0]["schema"] if kinds else None
    return schemas.where(F.col("schema") != F.lit(usual)).withColumn("usual", F.lit(usual))


#: an error names at most so many files; ``schema_offenders`` has them all
NAMED = 50


def check_same_schema(spark: SparkSession, path: str) -> None:
    """Reject a folder whose files differ in columns or types, naming the files that differ from the
    most common schema."""
    bad = schema_offenders(spark, path)
    some = bad.orderBy("file").take(NAMED + 1)
    if some:
        more = f"; and {bad.count() - NAMED} more" if len(some) > NAMED else ""
        raise SchemaError(f"files differ from ({some[0].usual}): " + "; ".join(f"{r.file} has ({r.schema})" for r in some[:NAMED]) + more)


def with_day(df: DataFrame, ts_col: str = "timestamp") -> DataFrame:
    """B2: add the ``timestamp_day`` partition column."""
    return df.withColumn("timestamp_day", F.to_date(F.col(ts_col)))


def write_day_partitioned(df: DataFrame, path: str, ts_col: str = "timestamp", mode: str = "append",
                          lineage: bool = True) -> None:
    """Write partitioned by day; ``mode`` skip | replace | create | append.

    With ``lineage`` every row keeps ``source_file`` (the input file name).
    """
    d = with_day(df, ts_col)
    if lineage and "source_file" not in d.columns:
        d = d.withColumn("source_file", F.col("_metadata.file_name"))
    clustered_by_time(d, "timestamp_day", ts_col).write.mode(MODES.get(mode, mode)) \
        .partitionBy("timestamp_day").parquet(path)


def clustered_by_time(df: DataFrame, day_col: str, ts_col: str) -> DataFrame:
    """Range-partition on (day, ts) before a ``partitionBy(day)`` write.

    Each task then holds one contiguous time span: it writes few day folders
    (not one file per task per day), and a very large day is still split over
    several tasks by the ``ts`` component of the range bounds.
    """
    return df.repartitionByRange(F.col(day_col), F.col(ts_col))


def load_folder(spark: SparkSession, src: str, dest: str, ts_col: str = "timestamp",
                mode: str = "append") -> T.StructType:
    """B5 + B2: validate the schema of the first file, check that all files have it, then load them."""
    schema = infer_schema(spark, src)
    validate_schema(schema, ts_col)
    check_same_schema(spark, src)
    df = spark.read.schema(schema).parquet(src)
    write_day_partitioned(df, dest, ts_col, mode)
    return schema


def manifest(table: DataFrame) -> DataFrame:
    """Rows per source file of a loaded table."""
    return table.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


def load_report(table: DataFrame) -> DataFrame:
    """Rows per (day partition, data file) - the planned files of a scan."""
    return (table.select("timestamp_day", F.col("_metadata.file_name").alias("data_file"))
                 .groupBy("timestamp_day", "data_file").agg(F.count(F.lit(1)).alias("rows")))


INDEX_SCHEMA = ("struct<tables:map<string,struct<zenodo_records:array<struct<label:string,doi:string>>>>,"
                "files:array<struct<key:string,checksum:string>>>")


def index_entries(index: DataFrame, col: str = "json") -> DataFrame:
    """A10: flatten a dataset index: (table, label, record_id) and (file, expected_md5).

    record id = last dot-separated field of the DOI; only ``.parquet`` files;
    expected checksum without its ``md5:`` prefix.
    """
    j = index.select(F.from_json(F.col(col), INDEX_SCHEMA).alias("j"))
    recs = (j.select(F.explode("j.tables").alias("table", "t"))
             .select("table", F.explode("t.zenodo_records").alias("r"))
             .select("table", F.col("r.label").alias("label"),
                     F.element_at(F.split(F.col("r.doi"), r"\."), -1).alias("record_id")))
    files = (j.select(F.explode("j.files").alias("f"))
              .select(F.col("f.key").alias("file"),
                      F.regexp_replace(F.col("f.checksum"), "^md5:", "").alias("expected_md5"))
              .where(F.col("file").endswith(".parquet")))
    return recs, files


#: bytes of a file that a task holds at once
PIECE = 8 << 20


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """A10: ``file, md5`` of every Parquet file of a folder. Tasks read files piece by piece, so a file may have any size;
    those of a file system that the workers don't know are read by Spark (``_digests_by_spark``)."""
    def elsewhere(batches):
        from urllib.parse import quote

        import pyarrow as pa
        import pyarrow.fs as pfs
        for b in batches:
            out = []
            for name in b.column("file").to_pylist():
                try:
                    pfs.FileSystem.from_uri(quote(name, safe=":/@[]"))
                except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
                    out.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["file"])

    def read(batches):
        import hashlib
        from urllib.parse import quote

        import pyarrow as pa
        import pyarrow.fs as pfs
        for b in batches:
            names, out = b.column("file").to_pylist(), []
            for name in names:
                fs, inner = pfs.FileSystem.from_uri(quote(name, safe=":/@[]"))
                md5 = hashlib.md5(usedforsecurity=False)
                with fs.open_input_stream(inner) as f:
                    while piece := f.read(PIECE):
                        md5.update(piece)
                out.append(md5.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], names=["file", "md5"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    files = content.select(F.col("path").alias("file"))
    if files.mapInArrow(elsewhere, "file string").isEmpty():
        return files.mapInArrow(read, "file string, md5 string")
    return _digests_by_spark(spark, path, content)


#: bytes of a file that a row may hold
WHOLE = 16 << 20
#: leading bytes that Hadoop's line reader takes away
BOM = b"\xef\xbb\xbf"


def _digests_by_spark(spark: SparkSession, path: str, content: DataFrame) -> DataFrame:
    """``file, md5`` of the Parquet files of a folder: those of up to WHOLE bytes from ``content``, Spark's binary reader,
    longer ones through its text reader, each in one task.

    There a row is a line, so no row holds a file. The lines, joined again, are the file but for a line feed at its end
    and a byte order mark at its start; its size tells whether it had them. A size that doesn't fit is an error.
    """
    def read(batches):
        import hashlib
        from urllib.parse import unquote

        import pyarrow as pa
        import pyarrow.compute as pc

        def digest(at, size, seen, plain, marked):
            if size - seen not in (0, 1, 3, 4):
                raise OSError(f"{at}: {seen} of {size} bytes read")
            md5 = marked if size - seen >= 3 else plain
            md5.update(b"\n" * ((size - seen) % 3))
            return pa.RecordBatch.from_arrays([pa.array([unquote(at)], pa.string()), pa.array([md5.hexdigest()], pa.string())], names=["file", "md5"])

        at, size, seen, sums = None, 0, 0, ()
        for b in batches:
            runs = pc.run_end_encode(b.column("at"))
            begin = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                lines = b.column("line").slice(begin, end - begin)
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")[0].as_buffer()
                if name != at:
                    if sums:
                        yield digest(at, size, seen, *sums)
                    at, size, seen = name, b.column("size")[begin].as_py(), 0
                    sums = hashlib.md5(usedforsecurity=False), hashlib.md5(BOM, usedforsecurity=False)
                else:
                    seen += 1
                    for md5 in sums:
                        md5.update(b"\n")
                seen += len(text)
                for md5 in sums:
                    md5.update(text)
                begin = end
        if sums:
            yield digest(at, size, seen, *sums)

    # a session of its own in which no file is cut: tasks read as much as the longest one has
    whole = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    whole.conf.set("spark.sql.files.maxPartitionBytes", content.agg(F.max("length")).first()[0])
    whole.conf.set("spark.sql.files.minPartitionNum", 1)
    lines = (whole.read.option("pathGlobFilter", "*.parquet").option("lineSep", "\n")
             .option("mapreduce.input.linerecordreader.line.maxlength", (1 << 31) - 1).text(path)
             .where(F.col("_metadata.file_size") > WHOLE)
             .select(F.col("_metadata.file_path").alias("at"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("line")))
    short = content.where(F.col("length") <= WHOLE).select(F.col("path").alias("file"), F.md5("content").alias("md5"))
    return short.unionByName(lines.mapInArrow(read, "file string, md5 string"))


def checksum_verify(spark: SparkSession, data_dir: str, expected: DataFrame) -> DataFrame:
    """A10: md5 of every parquet file vs the expectation (full outer join):
    file, expected_md5, actual_md5, status ok | mismatch | missing | unexpected."""
    actual = file_digests(spark, data_dir).select(F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), F.col("md5").alias("actual_md5"))
    j = expected.join(actual, "file", "full")
    status = (F.when(F.col("actual_md5").isNull(), "missing")
               .when(F.col("expected_md5").isNull(), "unexpected")
               .when(F.col("expected_md5") == F.col("actual_md5"), "ok").otherwise("mismatch"))
    return j.select("file", "expected_md5", "actual_md5", status.alias("status"))
