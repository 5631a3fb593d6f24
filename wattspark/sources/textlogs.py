"""Benchmark and serving logs as text corpora.

A corpus is a DataFrame ``(path, text)`` - one row per file - from
:func:`read_corpus` (``wholetext`` read + ``_metadata.file_path``) or rendered
by Spark from other tables. Every parser is a projection with Spark string
functions; files are parsed in parallel, one task per file split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattspark.functions.safe import nullif_empty


def read_corpus(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole files as rows: (path, text). ``pattern`` is a glob on file names."""
    r = spark.read
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    r = r.option("recursiveFileLookup", True)
    df = r.text(path, wholetext=True)  # the keyword: text() would reset an option to False
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Line-per-row corpus (path, line_no, line); ``line_no`` is 1-based within the file."""
    return explode_lines(read_corpus(spark, path, pattern))


def explode_lines(corpus: DataFrame) -> DataFrame:
    """(path, text) -> (path, line_no, line), CR stripped."""
    return corpus.select("path", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line")) \
                 .select("path", (F.col("pos") + 1).alias("line_no"),
                         F.regexp_replace("line", "\r$", "").alias("line"))


def _basename(col: str = "path") -> F.Column:
    return F.substring_index(F.col(col), "/", -1)


def once(df: DataFrame, parsed: str = "__p") -> DataFrame:
    """The fields of the struct column ``parsed`` as columns, evaluated once.

    A filter over plain projections is pushed below them, so it would evaluate the parse, and the
    projection above would evaluate it again. Generated columns are materialised by the generator.
    """
    return df.select(*[c for c in df.columns if c != parsed], F.inline(F.array(parsed)))


def _ws_split(c: F.Column) -> F.Column:
    """Python ``str.split()``: split on runs of whitespace, no empty ends."""
    return F.split(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+")


# --------------------------------------------------------------------------- A11
# The summary files' names, and the marker in front of their results.
IOR_NAME, IOR_MARK = r"^(.*)_(mpiio|posix)_summary\.txt_(\d+)", "Summary of all tests:"


def parse_ior_summaries(corpus: DataFrame) -> DataFrame:
    """fs_type (parent folder), scenario, api, run_id, bw_MiB, iops.

    Name ``<scenario>_<api>_summary.txt_<n>``; the first line containing
    ``Summary of all tests:`` is followed by a header row and the first result
    row; ``Mean(MiB)`` and ``Mean(OPs)`` are picked by header name, ``operation`` is that
    row's. Missing summary or column -> NULL; rows with NULL bandwidth are dropped.
    """
    name = _basename()
    part = lambda i: F.regexp_extract(name, IOR_NAME, i)
    d = corpus.where(name.rlike(IOR_NAME) & (part(1) != "")).select(
        F.substring_index(F.substring_index("path", "/", -2), "/", 1).alias("fs_type"),
        part(1).alias("scenario"), F.upper(part(2)).alias("api"), part(3).try_cast("bigint").alias("run_id"),
        F.instr("text", IOR_MARK).alias("__i"), "text")
    # from the first marker on: [rest of the marker line, header, first result row, rest]
    after = F.split(F.substring(F.col("text"), F.col("__i"), F.lit(2 ** 31 - 1)), "\n", 4)
    d = d.withColumn("__l", F.when(F.col("__i") > 0, after))
    d = d.withColumn("__h", _ws_split(F.try_element_at("__l", F.lit(2))))
    d = d.withColumn("__r", _ws_split(F.try_element_at("__l", F.lit(3))))
    pick = lambda h: F.when(F.array_position("__h", h) > 0,
                            F.try_element_at("__r", F.array_position("__h", h).cast("int")).try_cast("double"))
    d = once(d.select("fs_type", "scenario", "api", "run_id", F.struct(
        F.when(F.array_position("__h", "Operation") > 0, F.try_element_at("__r", F.array_position("__h", "Operation").cast("int"))).alias("operation"),
        pick("Mean(MiB)").alias("bw_MiB"), pick("Mean(OPs)").alias("iops")).alias("__p")))
    return d.where(F.col("bw_MiB").isNotNull())


# --------------------------------------------------------------------------- A12 / A13
# A load run's rate, and the names of the logs.
MEAN_RATE = r"\(mean rate\s+([\d,.]+)\s+([a-zA-Z/]+)\)"
TSDB_NAME = r"^([a-z-]+?)_(load|query)_ram(\d+)(?:Gi)?_cores(\d+)_iter(\d+)\.log$"


def _tsdb_config(name: F.Column) -> list[F.Column]:
    """db, ram, cpus, iter from ``<db>_<kind>_ram<r>[Gi]_cores<c>_iter<i>.log``."""
    return [F.regexp_extract(name, TSDB_NAME, 1).alias("db"),
            F.regexp_extract(name, TSDB_NAME, 3).try_cast("int").alias("ram"),
            F.regexp_extract(name, TSDB_NAME, 4).try_cast("int").alias("cpus"),
            F.regexp_extract(name, TSDB_NAME, 5).try_cast("bigint").alias("iter")]


def parse_tsdb_load_logs(lines: DataFrame) -> DataFrame:
    """First ``(mean rate N unit)`` line per file; thousands separators removed.

    Files without such a line are skipped. -> db, ram, cpus, iter, rows_per_sec, unit
    """
    # one search per line finds the rate; its number and unit are then taken from what was found
    hit = once(lines.where(F.col("line").contains("(mean rate")).select("path", "line_no", F.struct(F.regexp_extract("line", MEAN_RATE, 0).alias("__m")).alias("__p")))
    first = hit.where(F.col("__m") != "").groupBy("path").agg(F.min_by("__m", "line_no").alias("__m"))
    number = F.replace(F.regexp_extract("__m", MEAN_RATE, 1), F.lit(","), F.lit("")).try_cast("double")
    return first.select(*_tsdb_config(_basename()), number.alias("rows_per_sec"), F.regexp_extract("__m", MEAN_RATE, 2).alias("unit")).where(F.col("db") != "")


def _numbers(matched: F.Column, allow_commas: bool = False) -> F.Column:
    """Split a matched line into its numbers. The lines start with a word, so element 1
    is empty and the k-th number is element k + 1 (no higher-order function needed)."""
    return F.split(matched, r"[^0-9.,]+" if allow_commas else r"[^0-9.]+")


def parse_tsdb_query_logs(corpus: DataFrame) -> DataFrame:
    """Query-run summary per file, matched by pattern (an extra leading line is allowed).

    Each of the three lines (run, latency stats, wall clock) is located by ONE
    regex search; its numbers are then split out of the matched text.
    -> db, ram, cpus, iter, queries, workers, rate_qps, min_ms, med_ms, mean_ms,
       max_ms, stddev_ms, sum_s, count, wall_s
    """
    t = F.col("text")
    run = r"Run complete after [\d,]+ queries with \d+ workers \(Overall query rate [\d,\.]+ queries/sec\)"
    stats = (r"min:\s+[\d\.]+ms, med:\s+[\d\.]+ms, mean:\s+[\d\.]+ms, max:\s+[\d\.]+ms, "
             r"stddev:\s+[\d\.]+ms, sum:\s+[\d\.]+sec, count: \d+")
    wall = r"wall clock time: ([\d\.]+)sec"
    d = corpus.select(*_tsdb_config(_basename()),
                      _numbers(F.regexp_extract(t, run, 0), allow_commas=True).alias("__r"),
                      _numbers(F.regexp_extract(t, stats, 0)).alias("__s"),
                      nullif_empty(F.regexp_extract(t, wall, 1)).try_cast("double").alias("wall_s"))
    n = lambda a, i, ty: F.regexp_replace(F.try_element_at(a, F.lit(i + 1)), ",", "").try_cast(ty)
    out = once(d.select(F.struct(
        "db", "ram", "cpus", "iter",
        n("__r", 1, "bigint").alias("queries"), n("__r", 2, "int").alias("workers"),
        n("__r", 3, "double").alias("rate_qps"),
        n("__s", 1, "double").alias("min_ms"), n("__s", 2, "double").alias("med_ms"),
        n("__s", 3, "double").alias("mean_ms"), n("__s", 4, "double").alias("max_ms"),
        n("__s", 5, "double").alias("stddev_ms"), n("__s", 6, "double").alias("sum_s"),
        n("__s", 7, "bigint").alias("count"), "wall_s").alias("__p")))
    return out.where((F.col("db") != "") & F.col("rate_qps").isNotNull())


# --------------------------------------------------------------------------- A14 / A15
REQ = (r"^(.+?) \| max_tokens=(\d+) \| prompt=(\d+) completion=(\d+) total=(\d+) tokens \| "
       r"([\d\.]+)s$")


def parse_llm_requests(lines: DataFrame) -> DataFrame:
    """Request lines ``model | max_tokens=N | prompt=a completion=b total=c tokens | s``."""
    # one search per line; the model ends at the first bar, the rest are the line's numbers
    hit = once(lines.select("path", "line_no", F.struct(F.regexp_extract("line", REQ, 0).alias("__m")).alias("__p")))
    rest = F.split(F.substring(F.col("__m"), F.instr("__m", " | ") + 3, F.lit(2 ** 31 - 1)), r"[^0-9.]+")
    n = lambda i, ty: F.try_element_at("__n", F.lit(i + 1)).try_cast(ty)
    return hit.where(F.col("__m") != "").select("path", "line_no", F.substring_index("__m", " | ", 1).alias("model"), rest.alias("__n")).select(
        "path", "line_no", "model", n(1, "int").alias("max_tokens"), n(2, "bigint").alias("prompt_tokens"),
        n(3, "bigint").alias("completion_tokens"), n(4, "bigint").alias("total_tokens"), n(5, "double").alias("seconds"))


EVT = r"Experiment (START|END) \| id=([^ |]+) \| model=([^ |]+)(?: \| job=(\d+))?(?: \| nodes=(\S+))?"
AGG = r"^\s+Aggregated\s+(\d+)\s+(\d+)\(([\d\.]+)%\)\s+\|\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+\|\s+([\d\.]+)\s+([\d\.]+)"


def parse_llm_run_events(lines: DataFrame) -> DataFrame:
    """A15 (events): START / END marks -> path, status, id, model, job, nodes, logged_at."""
    l = F.col("line")
    g = lambda i: nullif_empty(F.regexp_extract(l, EVT, i))
    ts = F.try_to_timestamp(F.regexp_extract(l, r"^\[([0-9\- :]+),", 1), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.where(l.rlike(EVT)).select(
        "path", g(1).alias("status"), g(2).alias("id"), g(3).alias("model"), g(4).alias("job"),
        g(5).alias("nodes"), ts.cast("timestamp_ntz").alias("logged_at"))


def parse_llm_run_totals(lines: DataFrame) -> DataFrame:
    """A15 (counters): the last ``Aggregated`` status row of each file.

    -> path, requests, failures, failure_pct, avg_ms, min_ms, max_ms, med_ms, req_per_s, fail_per_s
    """
    l = F.col("line")
    g = lambda i, ty: F.regexp_extract(l, AGG, i).try_cast(ty)
    rows = lines.where(l.rlike(AGG)).select(
        "path", "line_no", g(1, "bigint").alias("requests"), g(2, "bigint").alias("failures"),
        g(3, "double").alias("failure_pct"), g(4, "bigint").alias("avg_ms"),
        g(5, "bigint").alias("min_ms"), g(6, "bigint").alias("max_ms"),
        g(7, "bigint").alias("med_ms"), g(8, "double").alias("req_per_s"),
        g(9, "double").alias("fail_per_s"))
    last = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("path",)]),
                                             "line_no").alias("r"))
    return last.select("path", *[F.col("r." + c).alias(c) for c in rows.columns if c not in ("path", "line_no")])


PCT = r"^\s+Aggregated\s+((?:\d+\s+){11})(\d+)\s*$"


def parse_llm_percentiles(lines: DataFrame) -> DataFrame:
    """A15 (percentiles): last aggregated percentile row of each file.

    -> path, p50, p66, p75, p80, p90, p95, p98, p99, p999, p9999, p100, n
    """
    l = F.col("line")
    rows = lines.where(l.rlike(PCT)).select(
        "path", "line_no", _ws_split(F.regexp_replace(l, r"^\s+Aggregated", "")).alias("v"))
    names = ["p50", "p66", "p75", "p80", "p90", "p95", "p98", "p99", "p999", "p9999", "p100", "n"]
    last = rows.groupBy("path").agg(F.max_by("v", "line_no").alias("v"))
    return last.select("path", *[F.col("v")[i].try_cast("bigint").alias(n) for i, n in enumerate(names)])


ERR = r"^(\d+)\s{2,}(.+?)\s*$"


def parse_llm_errors(lines: DataFrame) -> DataFrame:
    """A15 (errors): rows of the ``Error report`` block -> path, occurrences, error (last report)."""
    l = F.col("line")
    head = lines.where(l.startswith("Error report")).groupBy("path").agg(F.max("line_no").alias("__h"))
    d = lines.join(head, "path").where(F.col("line_no") > F.col("__h") + 2)
    return d.where(l.rlike(ERR)).select(
        "path", F.regexp_extract(l, ERR, 1).try_cast("bigint").alias("occurrences"),
        F.regexp_extract(l, ERR, 2).alias("error"))
