"""Text corpora rendered by Spark from the driver tables, in the shipped log formats.

They stand in for the benchmark / serving logs (not shipped with the data):
one file-row ``(path, text)`` per order, lineitem or conversation, so the
corpus grows with the tables and the parsers run over all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattspark.plans import views as V

# Fixed value: the header row of the tool's summary.
IOR_HEADER = ("Operation   Max(MiB)   Min(MiB)  Mean(MiB)     StdDev   Max(OPs)   Min(OPs)  Mean(OPs)"
              "     StdDev    Mean(s) Stonewall(s) Stonewall(MiB) Test# #Tasks tPN reps fPP reord"
              " reordoff reordrand seed segcnt   blksiz    xsize aggs(MiB)   API RefNum")


def ior_corpus(spark, d) -> DataFrame:
    """One IOR summary file per order: ``/ior/<fs>/<scenario>_<api>_summary.txt_<orderkey>``.

    Result rows are the order's lineitems by (line number, price, quantity)
    (Mean(MiB) = extended price, Mean(OPs) = quantity); every 13th order has no
    summary block. An order has at most seven lineitems, so each group is small.
    """
    li = V.table(spark, d, "lineitem")
    ok = F.col("l_orderkey")
    fs = F.when(ok % 2 == 0, "scratch").otherwise("fast")
    scen = F.element_at(F.array(*[F.lit(s) for s in V.IOR_SCENARIOS]),
                        (F.floor(ok / 2) % len(V.IOR_SCENARIOS) + 1).cast("int"))
    api = F.when(F.floor(ok / 14) % 2 == 0, "posix").otherwise("mpiio")
    op = F.when(F.col("l_linenumber") % 2 == 1, "write").otherwise("read")
    price, qty = F.col("l_extendedprice").cast("string"), F.col("l_quantity").cast("string")
    row = F.concat_ws("  ", op, price, price, price, F.lit("0.00"), qty, qty, qty, F.lit("0.00"),
                      F.lit("1.0"), F.lit("NA"), F.lit("NA"), F.lit("0"), F.lit("128"), F.lit("64"),
                      F.lit("1"), F.lit("0"), F.lit("0"), F.lit("1"), F.lit("0"), F.lit("0"), F.lit("1"),
                      F.lit("4096"), F.lit("4096"), F.lit("1.0"), api, F.lit("0"))
    per_order = li.groupBy("l_orderkey").agg(
        F.first(fs).alias("fs"), F.first(scen).alias("scen"), F.first(api).alias("api"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_extendedprice", "l_quantity",
                                             row.alias("row")))).alias("rows"))
    body = F.array_join(F.col("rows.row"), "\n")
    summary = F.when(F.col("l_orderkey") % 13 == 0, F.lit("Run aborted\n")).otherwise(
        F.concat(F.lit("Summary of all tests:\n"), F.lit(IOR_HEADER), F.lit("\n"), body, F.lit("\n")))
    text = F.concat(F.lit("IOR-4.0.0: MPI Coordinated Test of Parallel I/O\n\nResults: \n\n"), summary,
                    F.lit("Finished            : Fri Mar  6 07:54:35 2026\n"))
    path = F.concat(F.lit("/ior/"), F.col("fs"), F.lit("/"), F.col("scen"), F.lit("_"), F.col("api"),
                    F.lit("_summary.txt_"), F.col("l_orderkey").cast("string"))
    return per_order.select(path.alias("path"), text.alias("text"))


def tsdb_query_corpus(spark, d, db: str | None = None) -> DataFrame:
    """One query-run log per lineitem of the benchmark grid; every 5th order's logs
    carry an extra leading line. Iteration id = orderkey * 10 + line number.

    ``db`` reads one database's logs only (its own folder)."""
    li = V.table(spark, d, "lineitem")
    if db is not None:
        li = li.where(V.tsdb_db() == db)
    g = li.select("*", *V.tsdb_grid_columns())
    g = g.withColumn("iter", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    ms = lambda c: F.format_string("%.2f", c)
    text = F.concat(
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("Added index to hostname column of cpu table\n"))
         .otherwise(F.lit("")),
        F.lit("Run complete after 95000 queries with 8 workers (Overall query rate "),
        F.col("rate").cast("string"), F.lit(" queries/sec):\n"),
        F.lit("TSDB 5 cpu metric(s), random    1 hosts, random 12h0m0s by 1m:\n"),
        F.lit("min:     "), ms(F.col("l_discount") * 10), F.lit("ms, med:     "), ms(F.col("l_quantity") / 10),
        F.lit("ms, mean:     "), ms(F.col("l_quantity") / 8), F.lit("ms, max:   "), ms(F.col("l_quantity") * 2),
        F.lit("ms, stddev:     "), ms(F.col("l_tax") * 100), F.lit("ms, sum: 185.4sec, count: 95000\n"),
        F.lit("wall clock time: "), ms(F.col("l_quantity") + 20), F.lit("sec\n"))
    name = F.concat(F.col("db"), F.lit("_query_ram"), F.col("ram").cast("string"),
                    F.when(F.col("db") == "timescale", F.lit("")).otherwise(F.lit("Gi")),
                    F.lit("_cores"), F.col("cpus").cast("string"), F.lit("_iter"),
                    F.col("iter").cast("string"), F.lit(".log"))
    return g.select(F.concat(F.lit("/tsdb/"), F.col("db"), F.lit("/"), name).alias("path"),
                    text.alias("text"))


def tsdb_load_corpus(spark, d) -> DataFrame:
    """Load-run logs: one per order, rate = total price with thousands separators."""
    o = V.table(spark, d, "orders")
    db = (F.when(F.col("o_orderstatus") == "F", "influx")
           .when(F.col("o_orderstatus") == "O", "questdb").otherwise("timescale"))
    ram = ((F.col("o_orderkey") % 4 + 1) * 8).cast("int")
    cpus = F.when(F.col("o_orderkey") % 3 == 0, 8).otherwise(16)
    rate = F.format_number(F.col("o_totalprice"), 2)
    text = F.when(F.col("o_orderkey") % 17 == 0, F.lit("loader crashed\n")).otherwise(F.concat(
        F.lit("time,per. metric/s,metric total,overall metric/s\n"),
        F.lit("loaded 100 metrics in 1.2sec with 8 workers (mean rate "), rate,
        F.lit(" metrics/sec)\n"), F.lit("loaded 10 rows (mean rate 1.00 rows/sec)\n")))
    name = F.concat(db, F.lit("_load_ram"), ram.cast("string"), F.lit("Gi_cores"), cpus.cast("string"),
                    F.lit("_iter"), F.col("o_orderkey").cast("string"), F.lit(".log"))
    return o.select(F.concat(F.lit("/tsdb/"), db, F.lit("/"), name).alias("path"), text.alias("text"))


def llm_out_lines(spark, d) -> DataFrame:
    """Serving ``.out`` logs as a line corpus (path, line_no, line): one file per
    conversation, two header lines, then one request line per turn. Built row by
    row (no per-conversation collect), so a very long conversation is not a hot group."""
    c = V.table(spark, d, "conversations")
    path = F.concat(F.lit("/llm/benchmark_"), F.col("conv_id").cast("string"), F.lit(".out"))
    words = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    line = F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string"),
                    F.lit(" | max_tokens="), (F.lit(1000) + F.col("turn") * 7).cast("string"),
                    F.lit(" | prompt="), (F.col("turn") + 3).cast("string"),
                    F.lit(" completion="), words.cast("string"),
                    F.lit(" total="), (words + F.col("turn") + 3).cast("string"),
                    F.lit(" tokens | "), F.format_string("%.2f", F.length("text") / F.lit(100.0)), F.lit("s"))
    body = c.select(path.alias("path"), (F.col("turn") + 3).alias("line_no"), line.alias("line"))
    heads = c.select(path.alias("path")).distinct()
    head = heads.select("path", F.lit(1).cast("bigint").alias("line_no"), F.lit("Job started on node01").alias("line")) \
        .unionByName(heads.select("path", F.lit(2).cast("bigint").alias("line_no"),
                                  F.lit("Loaded 182 prompts from 'prompt.txt'.").alias("line")))
    return head.unionByName(body)
