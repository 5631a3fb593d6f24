"""Driver tables re-read as data-centre telemetry.

The real telemetry (IPMI, PDU, meters, GPUs, disks, NICs) is not shipped, so
each telemetry table is a projection of a driver table. Every view is a plain
projection/filter (no window, no join), so it scans in parallel and its size
is a fixed fraction of the driver table.

Mapping (fixed choices of this repository):

* host / device        : ``events.user_id`` (hosts), ``user_id % 40`` (racked devices)
* power sample          : ``events.ts``, ``events.value`` watts
* utilisation           : the ``k`` field of ``events.props`` (0-99)
* GPU index / PDU port  : ``events.event_type``
* run START / END       : ``signup`` / ``purchase`` events of a user
* counters              : a monotone function of the timestamp that wraps (resets)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattspark.functions.timecols import epoch_us

# I/O benchmark scenario names and API labels.
IOR_SCENARIOS = ["write_seq_4m", "read_seq_4m", "write_seq_4k", "read_seq_4k",
                 "write_rand_4k", "read_rand_4k", "writeread_rand_4k_shared"]
IOR_APIS = ["posix", "mpiio"]
# Fixed value: the meter description carries a double space (filter must match exactly).
METER_POWER_DESC = "Active power  line 2"
METER_TOTAL_DESC = "Active energy totaliser line 2"
N_DEVICES = 40          # racked devices behind the PDUs
N_IPMI_DEVICES = 30     # devices 0..29 also report through IPMI


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _device(uid: F.Column) -> F.Column:
    return F.concat(F.lit("dev"), F.lpad((uid % N_DEVICES).cast("string"), 2, "0"))


def machine_power(spark, d) -> DataFrame:
    """ipmi_power per host: timestamp, host, psu_id, unit, value, event_id."""
    e = table(spark, d, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("host"),
                    (F.col("event_id") % 2).cast("string").alias("psu_id"),
                    F.when(F.col("event_type") == "error", "A").otherwise("W").alias("unit"),
                    "value", "event_id")


def gpu_samples(spark, d) -> DataFrame:
    """nvidia_smi: timestamp, host, index (GPU), utilization_gpu, power_draw, event_id.

    GPU ``error`` reports 0 % utilisation, so it is idle in every run.
    """
    e = table(spark, d, "events")
    util = F.when(F.col("event_type") == "error", F.lit(0.0)).otherwise(_k().cast("double"))
    return e.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("host"),
                    F.col("event_type").alias("index"), util.alias("utilization_gpu"),
                    F.col("value").alias("power_draw"), "event_id")


def turbostat(spark, d) -> DataFrame:
    """turbostat: ``die='-'`` roll-up rows for view/click events, per-core rows otherwise."""
    e = table(spark, d, "events")
    die = F.when(F.col("event_type").isin("view", "click"), "-").otherwise("0")
    return e.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("host"),
                    die.alias("die"), F.col("value").alias("package_power_watt"),
                    (_k() / F.lit(10.0)).alias("ram_power_watt"), "event_id")


def llm_api_usage(spark, d) -> DataFrame:
    """Token usage rows: timestamp, host (the serving host), total_tokens."""
    e = table(spark, d, "events")
    return e.select(F.col("ts").alias("timestamp"), F.col("user_id").alias("host"),
                    (_k() * 10).alias("total_tokens"))


def llm_experiments(spark, d) -> DataFrame:
    """experiments table of LLM runs: timestamp, SLURM_JOB_ID, status, notes (= model)."""
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    return e.select(F.col("ts").alias("timestamp"),
                    F.col("user_id").cast("string").alias("SLURM_JOB_ID"),
                    F.when(F.col("event_type") == "signup", "START").otherwise("END").alias("status"),
                    F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("notes"))


def ior_experiments(spark, d) -> DataFrame:
    """experiments table of I/O runs with notes ``IOR-backend=<api>-scenario=<name>_<iter>``.

    Users with ``user_id % 11 == 0`` log ``IOR-idle`` (fails the note pattern).
    """
    e = table(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    api = F.element_at(F.array(*[F.lit(a) for a in IOR_APIS]), (F.col("user_id") % 2 + 1).cast("int"))
    scen = F.element_at(F.array(*[F.lit(s) for s in IOR_SCENARIOS]),
                        ((F.floor(F.col("user_id") / 2)) % len(IOR_SCENARIOS) + 1).cast("int"))
    note = F.when(F.col("user_id") % 11 == 0, F.lit("IOR-idle")).otherwise(
        F.concat(F.lit("IOR-backend="), api, F.lit("-scenario="), scen, F.lit("_"),
                 F.col("user_id").cast("string")))
    return e.select(F.col("ts").alias("timestamp"), F.lit("900001").alias("SLURM_JOB_ID"),
                    F.when(F.col("event_type") == "signup", "START").otherwise("END").alias("status"),
                    note.alias("notes"))


def pdu_power(spark, d) -> DataFrame:
    """pdu_power: timestamp, connected_device, port, value_W (all but ``view`` events)."""
    e = table(spark, d, "events").where(F.col("event_type") != "view")
    return e.select(F.col("ts").alias("timestamp"), _device(F.col("user_id")).alias("connected_device"),
                    F.col("event_type").alias("port"), F.col("value").alias("value_W"))


def ipmi_power(spark, d) -> DataFrame:
    """ipmi_power, host as FQDN. Only devices 0-29 have a BMC: every event is
    an IPMI reading of device ``user_id % 30``, so devices 30-39 appear on the PDUs only."""
    e = table(spark, d, "events")
    dev = F.concat(F.lit("dev"), F.lpad((F.col("user_id") % N_IPMI_DEVICES).cast("string"), 2, "0"))
    return e.select(F.col("ts").alias("timestamp"),
                    F.concat(dev, F.lit(".dc.example")).alias("host"),
                    (F.col("event_id") % 2).cast("string").alias("psu_id"),
                    F.when(F.col("event_type") == "error", "A").otherwise("W").alias("unit"),
                    F.col("value").alias("value"))


def energy_meter(spark, d) -> DataFrame:
    """energy_meter: ``view`` events are the site meter (power x 50); others the totaliser."""
    e = table(spark, d, "events")
    desc = F.when(F.col("event_type") == "view", F.lit(METER_POWER_DESC)).otherwise(F.lit(METER_TOTAL_DESC))
    return e.select(F.col("ts").alias("timestamp"), F.lit("W").alias("unit"),
                    (F.col("value") * 50).alias("value"), desc.alias("description"))


def _counter(mult: int, modulus: int) -> F.Column:
    """Monotone counter of wall-clock seconds that wraps at ``modulus`` (a reset)."""
    return ((F.floor(epoch_us("ts") / F.lit(1_000_000)) * F.lit(mult)) % F.lit(modulus)).cast("bigint")


def diskio(spark, d) -> DataFrame:
    """diskio: host, device name and cumulative counters with resets."""
    e = table(spark, d, "events")
    m = (F.col("user_id") % 7 + 1)
    return e.select(
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("io"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.concat(F.lit("sd"), F.substring("event_type", 1, 1)).alias("name"),
        ((F.floor(epoch_us("ts") / 1_000_000) * m * 4096) % (1 << 34)).cast("bigint").alias("read_bytes"),
        ((F.floor(epoch_us("ts") / 1_000_000) * m * 8192) % (1 << 35)).cast("bigint").alias("write_bytes"),
        _counter(3, 1 << 23).alias("reads"), _counter(5, 1 << 23).alias("writes"),
        _counter(1, 1 << 22).alias("merged_reads"), _counter(2, 1 << 22).alias("merged_writes"),
        _counter(7, 1 << 24).alias("read_time"), _counter(11, 1 << 25).alias("write_time"),
        _counter(13, 1 << 25).alias("io_time"), _counter(17, 1 << 26).alias("weighted_io_time"))


def net(spark, d) -> DataFrame:
    """net: interface names chosen so the infiniband class regex has hits and misses."""
    e = table(spark, d, "events")
    iface = (F.when(F.col("event_type") == "view", "ibp1s0")
              .when(F.col("event_type") == "click", "ipo_ib0")
              .when(F.col("event_type") == "error", "ipb2")
              .when(F.col("event_type") == "signup", "bond0")
              .otherwise("eno1"))
    return e.select(F.col("ts").alias("timestamp"),
                    F.concat(F.lit("io"), (F.col("user_id") % 4).cast("string")).alias("host"),
                    iface.alias("interface"),
                    _counter(1500, 1 << 33).alias("bytes_sent"), _counter(2500, 1 << 33).alias("bytes_recv"),
                    _counter(3, 1 << 24).alias("packets_sent"), _counter(4, 1 << 24).alias("packets_recv"))


def cpu(spark, d) -> DataFrame:
    """cpu: per-core usage percentages per host."""
    e = table(spark, d, "events")
    k = _k().cast("double")
    return e.select(F.col("ts").alias("timestamp"),
                    F.concat(F.lit("io"), (F.col("user_id") % 4).cast("string")).alias("host"),
                    (F.col("event_id") % 16).cast("string").alias("core_id"),
                    k.alias("usage_user"), (F.col("value") % 50).alias("usage_system"),
                    ((k * 7) % 13).alias("usage_iowait"), (F.lit(100.0) - k).alias("usage_idle"),
                    (k % 5).alias("usage_nice"))


def tsdb_db() -> F.Column:
    """Database of a benchmark-grid lineitem (from the return flag)."""
    return (F.when(F.col("l_returnflag") == "A", "influx")
             .when(F.col("l_returnflag") == "N", "questdb").otherwise("timescale"))


def tsdb_grid_columns() -> list:
    """db (returnflag), ram (8 x line number), cpus (line status), rate (extended price)."""
    return [tsdb_db().alias("db"), (F.col("l_linenumber") * 8).cast("int").alias("ram"),
            F.when(F.col("l_linestatus") == "F", 8).otherwise(16).cast("int").alias("cpus"),
            F.col("l_extendedprice").alias("rate")]


def tsdb_grid(spark, d) -> DataFrame:
    """Benchmark grid: db x ram x cpus x iteration -> rate, from ``lineitem``."""
    li = table(spark, d, "lineitem")
    return li.select(*tsdb_grid_columns(),
                     (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("iter"))
