"""Independent DuckDB SQL for each registered query (tables pre-registered as views).

Written directly against the driver tables with window functions and
``time_bucket``: deliberately not derived from the Spark plans.
"""

from __future__ import annotations

# Telemetry views over the driver tables, as DuckDB CTE bodies (same mapping as
# wattspark.plans.views, written independently).
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
DEV = "('dev' || lpad(CAST(user_id % 40 AS VARCHAR), 2, '0'))"
V = {
    "machine_power": f"""SELECT ts AS timestamp, user_id AS host, CAST(event_id % 2 AS VARCHAR) AS psu_id,
        CASE WHEN event_type = 'error' THEN 'A' ELSE 'W' END AS unit, value, event_id FROM events""",
    "gpu": f"""SELECT ts AS timestamp, user_id AS host, event_type AS "index",
        CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST({K} AS DOUBLE) END AS utilization_gpu,
        value AS power_draw, event_id FROM events""",
    "turbostat": f"""SELECT ts AS timestamp, user_id AS host,
        CASE WHEN event_type IN ('view', 'click') THEN '-' ELSE '0' END AS die,
        value AS package_power_watt, {K} / 10.0 AS ram_power_watt, event_id FROM events""",
    "pdu": f"""SELECT ts AS timestamp, {DEV} AS connected_device, event_type AS port, value AS value_W
        FROM events WHERE event_type <> 'view'""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({V[n]})" for n in names) + ",\n"


def _trapezoid(src: str, keys: str, p: str, tie: str = "event_id") -> str:
    """CTE text producing (keys..., dt_s, p_avg) rows with dt_s > 0 for a power series."""
    part = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"""lagged AS (
        SELECT {sel}timestamp, {p} AS p,
               lag(timestamp) OVER (w) AS pts, lag({p}) OVER (w) AS pp
        FROM {src} WHERE timestamp IS NOT NULL AND {p} IS NOT NULL
        WINDOW w AS ({part}ORDER BY timestamp, {tie})),
    iv AS (
        SELECT {sel}((epoch_us(timestamp) - epoch_us(pts)) // 1000) / 1000.0 AS dt_s, (p + pp) / 2.0 AS p_avg
        FROM lagged WHERE pts IS NOT NULL)"""


ORACLE: dict[str, str] = {}

ORACLE["i3_integrate_power_by_host"] = with_views("machine_power") + _trapezoid("machine_power", "host", "value") + """
SELECT host, round(sum(p_avg * dt_s), 6) AS energy_J, round(sum(p_avg * dt_s / 3600.0), 6) AS energy_Wh,
       round(sum(p_avg * dt_s / 3600000.0), 9) AS energy_kWh
FROM iv WHERE dt_s > 0 GROUP BY host"""

ORACLE["i2_integrate_power"] = with_views("machine_power") + _trapezoid("machine_power", "", "value") + """
SELECT round(coalesce(sum(p_avg * dt_s), 0.0), 3) AS energy_J,
       round(coalesce(sum(p_avg * dt_s / 3600.0), 0.0), 5) AS energy_Wh,
       round(coalesce(sum(p_avg * dt_s / 3600000.0), 0.0), 8) AS energy_kWh
FROM iv WHERE dt_s > 0"""

ORACLE["i4_integrate_cpu_energy"] = with_views("turbostat") + """
r AS (SELECT * FROM turbostat WHERE die = '-' AND timestamp IS NOT NULL
        AND package_power_watt IS NOT NULL AND ram_power_watt IS NOT NULL),
l AS (SELECT host, timestamp, package_power_watt AS pk, ram_power_watt AS rm,
        lag(timestamp) OVER w AS pts, lag(package_power_watt) OVER w AS ppk, lag(ram_power_watt) OVER w AS prm
      FROM r WINDOW w AS (PARTITION BY host ORDER BY timestamp, event_id)),
iv AS (SELECT host, ((epoch_us(timestamp) - epoch_us(pts)) // 1000) / 1000.0 AS dt_s,
        (pk + ppk) / 2.0 AS a, (rm + prm) / 2.0 AS b FROM l WHERE pts IS NOT NULL)
SELECT host,
  round(sum(a * dt_s), 6) AS pkg_energy_J, round(sum(a * dt_s / 3600.0), 6) AS pkg_energy_Wh,
  round(sum(a * dt_s / 3600000.0), 9) AS pkg_energy_kWh,
  round(sum(b * dt_s), 6) AS ram_energy_J, round(sum(b * dt_s / 3600.0), 6) AS ram_energy_Wh,
  round(sum(b * dt_s / 3600000.0), 9) AS ram_energy_kWh
FROM iv WHERE dt_s > 0 GROUP BY host"""

ORACLE["f1_tumbling_10m"] = with_views("gpu") + """
x AS (SELECT 1)
SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, "index",
       round(avg(power_draw), 6) AS mean_W, count(*) AS n
FROM gpu GROUP BY 1, 2"""

ORACLE["f2_tumbling_centered"] = """
SELECT time_bucket(INTERVAL '1 second', ts) + INTERVAL '500 milliseconds' AS ts_center,
       round(sum(value), 6) AS total_value
FROM events GROUP BY 1"""

ORACLE["e4_two_level_power"] = with_views("pdu") + """
pp AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, connected_device, port,
         avg(value_W) AS value_W FROM pdu GROUP BY 1, 2, 3)
SELECT timestamp, round(sum(value_W), 6) AS total_power_W FROM pp GROUP BY timestamp"""

ORACLE["g4_trim_ends"] = with_views("pdu") + """
pp AS (SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, connected_device, port,
         avg(value_W) AS value_W FROM pdu GROUP BY 1, 2, 3),
t AS (SELECT timestamp, round(sum(value_W), 6) AS total_power_W FROM pp GROUP BY timestamp)
SELECT * FROM t WHERE timestamp > (SELECT min(timestamp) FROM t) AND timestamp < (SELECT max(timestamp) FROM t)"""

ORACLE["f8_diff_over"] = with_views("machine_power") + """
x AS (SELECT 1)
SELECT event_id, host, timestamp,
       round(value - lag(value) OVER (PARTITION BY host ORDER BY timestamp, event_id), 6) AS value_diff
FROM machine_power"""

ORACLE["f10_elapsed_ms"] = with_views("machine_power") + """
x AS (SELECT 1)
SELECT event_id, host,
       (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY host ORDER BY timestamp, event_id))) // 1000 AS dt_ms
FROM machine_power"""

ORACLE["f9_row_index"] = """
SELECT event_id, event_type,
       row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx
FROM events WHERE event_type IN ('signup', 'purchase')"""

ORACLE["f4_per_second_counts"] = """
SELECT time_bucket(INTERVAL '1 second', ts) AS second, count(*) AS count FROM events GROUP BY 1"""

V["llm_runs"] = """SELECT CAST(user_id AS VARCHAR) AS run_id, user_id AS host,
        'model-' || CAST(user_id % 3 AS VARCHAR) AS model,
        min(ts) FILTER (WHERE event_type = 'signup') AS start,
        min(ts) FILTER (WHERE event_type = 'purchase') AS "end"
    FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id
    HAVING min(ts) FILTER (WHERE event_type = 'signup') IS NOT NULL
       AND min(ts) FILTER (WHERE event_type = 'purchase') IS NOT NULL"""
_SC = "['write_seq_4m','read_seq_4m','write_seq_4k','read_seq_4k','write_rand_4k','read_rand_4k','writeread_rand_4k_shared']"
V["ior_marks"] = f"""SELECT ts AS timestamp, CASE WHEN event_type = 'signup' THEN 'START' ELSE 'END' END AS status,
        upper(CASE WHEN user_id % 2 = 0 THEN 'posix' ELSE 'mpiio' END) AS backend,
        {_SC}[CAST((user_id // 2) % 7 AS INTEGER) + 1] AS scenario, user_id AS iter
    FROM events WHERE event_type IN ('signup', 'purchase') AND user_id % 11 <> 0"""
V["ior_pairs"] = """SELECT s.backend, s.scenario, s.iter, s.idx, s.timestamp AS start, e.timestamp AS "end" FROM
      (SELECT *, row_number() OVER (PARTITION BY backend, scenario, iter ORDER BY timestamp) - 1 AS idx
         FROM ior_marks WHERE status = 'START') s
      JOIN (SELECT *, row_number() OVER (PARTITION BY backend, scenario, iter ORDER BY timestamp) - 1 AS idx
         FROM ior_marks WHERE status = 'END') e
      USING (backend, scenario, iter, idx) WHERE e.timestamp >= s.timestamp"""
V["ipmi"] = """SELECT ts AS timestamp, 'dev' || lpad(CAST(user_id % 30 AS VARCHAR), 2, '0') || '.dc.example' AS host,
        CAST(event_id % 2 AS VARCHAR) AS psu_id, CASE WHEN event_type = 'error' THEN 'A' ELSE 'W' END AS unit, value
    FROM events"""
V["meter10"] = """SELECT time_bucket(INTERVAL '10 minutes', ts) AS timestamp, avg(value * 50) AS value
    FROM events WHERE event_type = 'view' GROUP BY 1"""
V["pdu10"] = """SELECT timestamp, sum(value_W) AS total_power_W FROM (
        SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, connected_device, port,
               avg(value_W) AS value_W FROM pdu GROUP BY 1, 2, 3) GROUP BY timestamp"""
V["pue"] = """SELECT m.timestamp, m.value / nullif(p.total_power_W, 0) AS ratio
    FROM meter10 m JOIN pdu10 p USING (timestamp)"""

ORACLE["i1_experiment_runs"] = with_views("llm_runs") + """x AS (SELECT 1)
SELECT run_id, model, start, "end" FROM llm_runs"""

ORACLE["e5_pivot_first"] = with_views("ior_marks") + """x AS (SELECT 1)
SELECT backend, scenario, iter, min(timestamp) FILTER (WHERE status = 'START') AS start,
       min(timestamp) FILTER (WHERE status = 'END') AS "end"
FROM ior_marks GROUP BY ALL"""

ORACLE["i1_runs_long"] = with_views("llm_runs") + """x AS (SELECT 1)
SELECT run_id, 'start' AS mark, start AS timestamp FROM llm_runs
UNION ALL SELECT run_id, 'end' AS mark, "end" AS timestamp FROM llm_runs"""

ORACLE["h1_regex_extract"] = """
SELECT DISTINCT CASE WHEN user_id % 11 = 0 THEN 'IOR-idle' ELSE 'IOR-backend=' || CASE WHEN user_id % 2 = 0 THEN 'posix' ELSE 'mpiio' END
         || '-scenario=' || ['write_seq_4m','read_seq_4m','write_seq_4k','read_seq_4k','write_rand_4k','read_rand_4k','writeread_rand_4k_shared'][CAST((user_id // 2) % 7 AS INTEGER) + 1]
         || '_' || CAST(user_id AS VARCHAR) END AS notes,
       upper(CASE WHEN user_id % 2 = 0 THEN 'posix' ELSE 'mpiio' END) AS backend,
       ['write_seq_4m','read_seq_4m','write_seq_4k','read_seq_4k','write_rand_4k','read_rand_4k','writeread_rand_4k_shared'][CAST((user_id // 2) % 7 AS INTEGER) + 1] AS scenario,
       user_id AS iter
FROM events WHERE event_type IN ('signup', 'purchase') AND user_id % 11 <> 0"""

ORACLE["d3_start_end_pairing"] = with_views("ior_marks", "ior_pairs") + """x AS (SELECT 1)
SELECT * FROM ior_pairs"""

ORACLE["d4_run_window_join"] = with_views("llm_runs", "machine_power") + """x AS (SELECT 1)
SELECT r.run_id, m.event_id FROM machine_power m JOIN llm_runs r ON m.host = r.host
 AND m.timestamp BETWEEN r.start - INTERVAL 60 SECOND AND r."end" + INTERVAL 60 SECOND"""

ORACLE["d5_interval_union_filter"] = with_views("ior_marks", "ior_pairs") + """x AS (SELECT 1)
SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM ior_pairs p WHERE e.ts BETWEEN p.start AND p."end")"""

ORACLE["g5_run_viewport"] = with_views("llm_runs") + """
o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY start, "end") - 1 AS i,
             count(*) OVER (PARTITION BY model) AS n FROM llm_runs)
SELECT model, min(start) FILTER (WHERE i = least(0, n - 1)) - INTERVAL 30 SECOND AS view_start,
       min("end") FILTER (WHERE i = least(1, n - 1)) + INTERVAL 30 SECOND AS view_end
FROM o GROUP BY model"""

ORACLE["e15_token_sum"] = with_views("llm_runs") + f"""x AS (SELECT 1)
SELECT r.run_id, CAST(sum({K} * 10) AS BIGINT) AS total_tokens FROM events e JOIN llm_runs r
  ON e.user_id = r.host AND e.ts BETWEEN r.start AND r."end" GROUP BY r.run_id"""

_GPU_SPLIT = """
g AS (SELECT r.run_id, x.* FROM gpu x JOIN llm_runs r ON x.host = r.host AND x.timestamp BETWEEN r.start AND r."end"),
gs AS (SELECT run_id, "index", avg(utilization_gpu) AS u FROM g
       WHERE "index" IS NOT NULL AND utilization_gpu IS NOT NULL GROUP BY ALL),
gl AS (SELECT run_id, "index", timestamp, power_draw AS p, lag(timestamp) OVER w AS pts, lag(power_draw) OVER w AS pp
       FROM g WHERE "index" IS NOT NULL AND timestamp IS NOT NULL AND power_draw IS NOT NULL
       WINDOW w AS (PARTITION BY run_id, "index" ORDER BY timestamp, event_id)),
gi AS (SELECT run_id, "index", ((epoch_us(timestamp) - epoch_us(pts)) // 1000) / 1000.0 AS dt_s, (p + pp) / 2.0 AS pa
       FROM gl WHERE pts IS NOT NULL),
ge AS (SELECT run_id, "index", sum(pa * dt_s / 3600.0) AS wh FROM gi WHERE dt_s > 0 GROUP BY ALL),
split AS (SELECT gs.run_id,
    count(*) FILTER (WHERE u >= 1.0) AS active_gpus,
    avg(u) FILTER (WHERE u >= 1.0) AS avg_active_util,
    coalesce(sum(coalesce(wh, 0.0)) FILTER (WHERE u >= 1.0), 0.0) AS active_gpu_Wh,
    count(*) FILTER (WHERE u < 1.0) AS inactive_gpus,
    avg(u) FILTER (WHERE u < 1.0) AS avg_inactive_util,
    coalesce(sum(coalesce(wh, 0.0)) FILTER (WHERE u < 1.0), 0.0) AS inactive_gpu_Wh
  FROM gs LEFT JOIN ge USING (run_id, "index") GROUP BY gs.run_id)"""

ORACLE["i5_gpu_activity_split"] = with_views("llm_runs", "gpu") + _GPU_SPLIT + """
SELECT run_id, active_gpus, round(avg_active_util, 6) AS avg_active_util, round(active_gpu_Wh, 6) AS active_gpu_Wh,
       inactive_gpus, round(avg_inactive_util, 6) AS avg_inactive_util, round(inactive_gpu_Wh, 6) AS inactive_gpu_Wh
FROM split"""

ORACLE["i6_llm_energy_report"] = with_views("llm_runs", "gpu", "machine_power", "turbostat", "pdu", "meter10",
                                            "pdu10", "pue") + _GPU_SPLIT + f""",
tok AS (SELECT r.run_id, sum({K} * 10) AS total_tokens FROM events e JOIN llm_runs r
        ON e.user_id = r.host AND e.ts BETWEEN r.start AND r."end" GROUP BY r.run_id),
sl AS (SELECT r.run_id, m.timestamp, m.value AS p, lag(m.timestamp) OVER w AS pts, lag(m.value) OVER w AS pp
       FROM machine_power m JOIN llm_runs r ON m.host = r.host AND m.timestamp BETWEEN r.start AND r."end"
       WHERE m.psu_id = '0' AND m.unit = 'W' AND m.value IS NOT NULL
       WINDOW w AS (PARTITION BY r.run_id ORDER BY m.timestamp, m.event_id)),
se AS (SELECT run_id, sum((p + pp) / 2.0 * (((epoch_us(timestamp) - epoch_us(pts)) // 1000) / 1000.0) / 3600.0) AS sys_Wh
       FROM sl WHERE pts IS NOT NULL AND (epoch_us(timestamp) - epoch_us(pts)) // 1000 > 0 GROUP BY run_id),
cl AS (SELECT r.run_id, t.timestamp, t.package_power_watt AS a, t.ram_power_watt AS b,
              lag(t.timestamp) OVER w AS pts, lag(t.package_power_watt) OVER w AS pa, lag(t.ram_power_watt) OVER w AS pb
       FROM turbostat t JOIN llm_runs r ON t.host = r.host AND t.timestamp BETWEEN r.start AND r."end"
       WHERE t.die = '-' AND t.package_power_watt IS NOT NULL AND t.ram_power_watt IS NOT NULL
       WINDOW w AS (PARTITION BY r.run_id ORDER BY t.timestamp, t.event_id)),
ci AS (SELECT run_id, ((epoch_us(timestamp) - epoch_us(pts)) // 1000) / 1000.0 AS dt_s, a, b, pa, pb FROM cl WHERE pts IS NOT NULL),
ce AS (SELECT run_id, sum((a + pa) / 2.0 * dt_s / 3600.0) + sum((b + pb) / 2.0 * dt_s / 3600.0) AS cpu_Wh
       FROM ci WHERE dt_s > 0 GROUP BY run_id),
ap AS (SELECT r.run_id, avg(p.ratio) AS avg_pue FROM pue p JOIN llm_runs r ON p.timestamp BETWEEN r.start AND r."end"
       GROUP BY r.run_id),
rep AS (SELECT r.*, s.*, t.total_tokens, se.sys_Wh, ce.cpu_Wh, ap.avg_pue,
        (epoch_us(r."end") - epoch_us(r.start)) / 1000000.0 AS dur_s
        FROM llm_runs r JOIN split s USING (run_id) JOIN tok t USING (run_id)
        LEFT JOIN se USING (run_id) LEFT JOIN ce USING (run_id) LEFT JOIN ap USING (run_id)
        WHERE s.active_gpus > 0 AND t.total_tokens > 0)
SELECT run_id, model, active_gpus,
  round(CASE WHEN dur_s > 0 THEN total_tokens / dur_s ELSE 0.0 END, 5) AS tokens_per_s,
  round(avg_active_util, 5) AS avg_active_gpu_util,
  round(active_gpu_Wh / total_tokens * 1000.0, 5) AS active_gpu_Wh_per_1k,
  round(inactive_gpu_Wh / total_tokens * 1000.0, 5) AS inactive_gpu_Wh_per_1k,
  round(cpu_Wh / total_tokens * 1000.0, 5) AS cpu_Wh_per_1k,
  round(sys_Wh / total_tokens * 1000.0, 5) AS system_Wh_per_1k,
  round(sys_Wh / total_tokens * avg_pue * 1000.0, 5) AS adjusted_Wh_per_1k
FROM rep"""

ORACLE["i7_pue_series"] = with_views("pdu", "meter10", "pdu10", "pue") + """x AS (SELECT 1)
SELECT timestamp, round(ratio, 9) AS ratio FROM pue"""

ORACLE["e3_filtered_mean"] = with_views("ipmi") + """x AS (SELECT 1)
SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, host,
       round(avg(value) FILTER (WHERE psu_id = '0' AND unit = 'W'), 6) AS value_W
FROM ipmi GROUP BY 1, 2"""

ORACLE["d6_host_set_difference"] = with_views("pdu", "ipmi") + """x AS (SELECT 1)
SELECT DISTINCT connected_device FROM pdu EXCEPT SELECT DISTINCT split_part(host, '.', 1) FROM ipmi"""

ORACLE["i8_power_reconciliation"] = with_views("pdu", "ipmi", "meter10", "pdu10") + """
missing AS (SELECT DISTINCT connected_device FROM pdu EXCEPT SELECT DISTINCT split_part(host, '.', 1) FROM ipmi),
mp AS (SELECT timestamp, sum(value_W) AS total_power_W FROM (
        SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, connected_device, port, avg(value_W) AS value_W
        FROM pdu WHERE connected_device IN (SELECT * FROM missing) GROUP BY 1, 2, 3) GROUP BY 1),
ip AS (SELECT timestamp, coalesce(sum(v), 0) AS total_power_W FROM (
        SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, host,
               avg(value) FILTER (WHERE psu_id = '0' AND unit = 'W') AS v FROM ipmi GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT coalesce(p.timestamp, i.timestamp, m.timestamp, e.timestamp) AS timestamp,
        p.total_power_W / 1000.0 AS pdu_kW, i.total_power_W / 1000.0 AS ipmi_kW, m.total_power_W / 1000.0 AS missing_kW,
        e.value / 1000.0 AS meter_kW
      FROM pdu10 p FULL JOIN ip i USING (timestamp) FULL JOIN mp m USING (timestamp) FULL JOIN meter10 e USING (timestamp))
SELECT timestamp, round(pdu_kW, 9) AS pdu_kW, round(ipmi_kW, 9) AS ipmi_kW, round(missing_kW, 9) AS missing_kW,
       round(ipmi_kW + missing_kW, 9) AS ipmi_plus_missing_kW, round(meter_kW, 9) AS meter_kW
FROM j WHERE timestamp > (SELECT min(timestamp) FROM j) AND timestamp < (SELECT max(timestamp) FROM j)"""

ORACLE["c14_weather_overlay"] = with_views("pdu", "meter10", "pdu10", "pue") + """
w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS date, avg(value) AS t FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT date, round(t, 6) AS temperature_2m FROM w
WHERE date >= (SELECT min(timestamp) FROM pue) AND date <= (SELECT max(timestamp) FROM pue)"""

# ----------------------------------------------------------------------------- I/O
def _cnt(mult: int, mod: int) -> str:
    return f"CAST(((epoch_us(ts) // 1000000) * {mult}) % {mod} AS BIGINT)"


V["diskio"] = f"""SELECT ts AS timestamp, 'io' || CAST(user_id % 4 AS VARCHAR) AS host, 'sd' || substr(event_type, 1, 1) AS name,
        CAST(((epoch_us(ts) // 1000000) * (user_id % 7 + 1) * 4096) % {1 << 34} AS BIGINT) AS read_bytes,
        CAST(((epoch_us(ts) // 1000000) * (user_id % 7 + 1) * 8192) % {1 << 35} AS BIGINT) AS write_bytes,
        {_cnt(3, 1 << 23)} AS reads, {_cnt(5, 1 << 23)} AS writes, {_cnt(1, 1 << 22)} AS merged_reads,
        {_cnt(2, 1 << 22)} AS merged_writes, {_cnt(7, 1 << 24)} AS read_time, {_cnt(11, 1 << 25)} AS write_time,
        {_cnt(13, 1 << 25)} AS io_time, {_cnt(17, 1 << 26)} AS weighted_io_time FROM events"""
V["net"] = f"""SELECT ts AS timestamp, 'io' || CAST(user_id % 4 AS VARCHAR) AS host,
        CASE event_type WHEN 'view' THEN 'ibp1s0' WHEN 'click' THEN 'ipo_ib0' WHEN 'error' THEN 'ipb2'
             WHEN 'signup' THEN 'bond0' ELSE 'eno1' END AS interface,
        {_cnt(1500, 1 << 33)} AS bytes_sent, {_cnt(2500, 1 << 33)} AS bytes_recv,
        {_cnt(3, 1 << 24)} AS packets_sent, {_cnt(4, 1 << 24)} AS packets_recv FROM events"""
V["cpu"] = f"""SELECT ts AS timestamp, 'io' || CAST(user_id % 4 AS VARCHAR) AS host, CAST(event_id % 16 AS VARCHAR) AS core_id,
        CAST({K} AS DOUBLE) AS usage_user, value % 50 AS usage_system, (CAST({K} AS DOUBLE) * 7) % 13 AS usage_iowait,
        100.0 - CAST({K} AS DOUBLE) AS usage_idle, CAST({K} AS DOUBLE) % 5 AS usage_nice FROM events"""
V["spw"] = """SELECT timestamp, host, CAST(psu_id AS INTEGER) AS psu_id, unit, value FROM ipmi
    WHERE unit = 'W' AND TRY_CAST(psu_id AS INTEGER) = 0 AND host LIKE 'dev%'"""

_RATES = ["read_bytes", "write_bytes", "reads", "writes", "merged_reads", "merged_writes"]
_DISK = _RATES + ["read_time", "write_time", "io_time", "weighted_io_time"]


def _disk_rates_sql(src: str, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    sel = f"{keys}, " if keys else ""
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _DISK)
    rates = ", ".join(f"coalesce(greatest({c} - lag({c}) OVER w, 0), 0) AS {c}_rate" for c in _RATES)
    return f"""ds AS (SELECT {sel}time_bucket(INTERVAL '1 second', timestamp) AS ts, {sums} FROM {src} GROUP BY ALL),
    dr AS (SELECT {sel}ts, {rates} FROM ds WINDOW w AS ({part}ORDER BY ts)),
    dm AS (SELECT *, read_bytes_rate / 1048576.0 AS read_MBps, write_bytes_rate / 1048576.0 AS write_MBps FROM dr)"""


ORACLE["c5_power_row_filter"] = with_views("ipmi", "spw") + """x AS (SELECT 1)
SELECT * FROM spw"""

ORACLE["i9_disk_rates"] = with_views("diskio") + _disk_rates_sql("diskio", "") + """
SELECT ts, """ + ", ".join(c + "_rate" for c in _RATES) + """, round(read_MBps, 6) AS read_MBps,
       round(write_MBps, 6) AS write_MBps FROM dm"""

_IO_SUMMARY = """
ranges AS (SELECT backend, scenario, min(timestamp) FILTER (WHERE status = 'START') AS start,
                  max(timestamp) FILTER (WHERE status = 'END') AS "end" FROM ior_marks GROUP BY ALL),
dkr AS (SELECT r.backend, r.scenario, d.* FROM diskio d JOIN ranges r
        ON d.timestamp BETWEEN r.start - INTERVAL 60 SECOND AND r."end" + INTERVAL 60 SECOND),
""" + _disk_rates_sql("dkr", "backend, scenario") + """,
pr AS (SELECT r.backend, r.scenario, time_bucket(INTERVAL '1 second', p.timestamp) AS ts, sum(p.value) AS total_power_W
       FROM spw p JOIN ranges r ON p.timestamp BETWEEN r.start - INTERVAL 60 SECOND AND r."end" + INTERVAL 60 SECOND
       GROUP BY ALL),
eff AS (SELECT dm.*, pr.total_power_W, read_MBps + write_MBps AS total_MBps,
               reads_rate + writes_rate + merged_reads_rate + merged_writes_rate AS total_iops
        FROM dm JOIN pr USING (backend, scenario, ts)),
eff2 AS (SELECT *, CASE WHEN total_power_W > 0 THEN total_MBps / total_power_W END AS MBps_per_watt,
                   CASE WHEN total_power_W > 0 THEN total_iops / total_power_W END AS iops_per_watt FROM eff),
inside AS (SELECT * FROM eff2 e WHERE EXISTS (SELECT 1 FROM ior_pairs p WHERE p.backend = e.backend
           AND p.scenario = e.scenario AND e.ts BETWEEN p.start AND p."end")),
summary AS (SELECT g.backend, g.scenario, avg(MBps_per_watt) AS mean_MBps_per_watt, avg(iops_per_watt) AS mean_iops_per_watt,
       avg(total_MBps) AS mean_MBps, avg(total_iops) AS mean_iops, avg(total_power_W) AS mean_power_W
       FROM ranges g LEFT JOIN inside i USING (backend, scenario) GROUP BY g.backend, g.scenario)"""

ORACLE["i10_io_power_efficiency"] = with_views("ior_marks", "ior_pairs", "diskio", "ipmi", "spw") + _IO_SUMMARY + """
SELECT backend, scenario, round(mean_MBps_per_watt, 6) AS mean_MBps_per_watt, round(mean_iops_per_watt, 6) AS mean_iops_per_watt,
       round(mean_MBps, 6) AS mean_MBps, round(mean_iops, 6) AS mean_iops, round(mean_power_W, 6) AS mean_power_W
FROM summary"""

V["ior_rows"] = """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'scratch' ELSE 'fast' END AS fs_type,
        ['write_seq_4m','read_seq_4m','write_seq_4k','read_seq_4k','write_rand_4k','read_rand_4k','writeread_rand_4k_shared'][CAST((l_orderkey // 2) % 7 AS INTEGER) + 1] AS scenario,
        CASE WHEN (l_orderkey // 14) % 2 = 0 THEN 'POSIX' ELSE 'MPIIO' END AS api, l_orderkey AS run_id,
        CASE WHEN min(l_linenumber) % 2 = 1 THEN 'write' ELSE 'read' END AS operation,
        first(l_extendedprice ORDER BY l_linenumber, l_extendedprice, l_quantity) AS bw_MiB,
        first(l_quantity ORDER BY l_linenumber, l_extendedprice, l_quantity) AS iops
    FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY l_orderkey"""
V["ior_perf"] = """SELECT fs_type, scenario, api, avg(bw_MiB) AS bw_MiB, avg(iops) AS iops FROM ior_rows GROUP BY ALL"""

ORACLE["a11_ior_summary_scan"] = with_views("ior_rows") + """x AS (SELECT 1)
SELECT * FROM ior_rows"""

ORACLE["i11_ior_performance"] = with_views("ior_rows", "ior_perf") + """x AS (SELECT 1)
SELECT fs_type, scenario, api, round(bw_MiB, 6) AS bw_MiB, round(iops, 6) AS iops FROM ior_perf"""


def _fz(expr: str) -> str:
    return f"coalesce(CASE WHEN isfinite({expr}) THEN {expr} END, 0.0)"


ORACLE["i12_efficiency_comparison"] = with_views("ior_marks", "ior_pairs", "diskio", "ipmi", "spw", "ior_rows",
                                                 "ior_perf") + _IO_SUMMARY + """,
realp AS (SELECT scenario, api AS backend, avg(bw_MiB) AS bw, avg(iops) AS io FROM ior_perf GROUP BY ALL)
SELECT s.backend, s.scenario, round(mean_MBps_per_watt, 3) AS diskio_MBps_per_watt,
  round(""" + _fz("bw / nullif(mean_power_W, 0)") + """, 3) AS IOR_MBps_per_watt,
  round(mean_iops_per_watt, 3) AS diskio_iops_per_watt,
  round(""" + _fz("io / nullif(mean_power_W, 0)") + """, 3) AS IOR_iops_per_watt,
  round(""" + _fz("bw / nullif(mean_MBps, 0)") + """, 3) AS bw_rateo,
  round(""" + _fz("io / nullif(mean_iops, 0)") + """, 3) AS iops_rateo,
  round(mean_power_W, 2) AS mean_power_W
FROM summary s JOIN realp r ON s.scenario = r.scenario AND s.backend = r.backend"""

ORACLE["i13_power_series"] = with_views("ipmi", "spw") + """x AS (SELECT 1)
SELECT time_bucket(INTERVAL '1 second', timestamp) + INTERVAL '500 milliseconds' AS ts_center,
       round(sum(value), 6) AS total_value FROM spw GROUP BY 1"""

ORACLE["i14_cpu_series"] = with_views("cpu") + """
ph AS (SELECT host, timestamp, avg(usage_user) AS u, avg(usage_system) AS s, avg(usage_iowait) AS w FROM cpu GROUP BY ALL)
SELECT time_bucket(INTERVAL '1 second', timestamp) + INTERVAL '500 milliseconds' AS ts_center,
       round(sum(u), 6) AS usage_user, round(sum(s), 6) AS usage_system, round(sum(w), 6) AS usage_iowait
FROM ph GROUP BY 1"""

_NETC = ["bytes_sent", "bytes_recv", "packets_sent", "packets_recv"]
ORACLE["i15_network_rates"] = with_views("net") + """
nc AS (SELECT *, CASE WHEN regexp_matches(interface, 'ipo_ib|^ibp|^ipb') THEN 'infiniband' ELSE interface END AS iface_class FROM net),
ns AS (SELECT time_bucket(INTERVAL '1 second', timestamp) AS ts, iface_class, """ + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _NETC) + """ FROM nc GROUP BY ALL),
nr AS (SELECT ts, iface_class, """ + ", ".join(
    f"coalesce(greatest({c} - lag({c}) OVER w, 0), 0) AS {c}_rate" for c in _NETC) + """
       FROM ns WINDOW w AS (PARTITION BY iface_class ORDER BY ts))
SELECT *, round(bytes_sent_rate / 1048576.0, 6) AS sent_MBps, round(bytes_recv_rate / 1048576.0, 6) AS recv_MBps FROM nr"""

ORACLE["h3_interface_class"] = with_views("net") + """x AS (SELECT 1)
SELECT DISTINCT interface, CASE WHEN regexp_matches(interface, 'ipo_ib|^ibp|^ipb') THEN 'infiniband' ELSE interface END AS iface_class FROM net"""

# ----------------------------------------------------------------------------- quality
_DELTA = "abs(epoch_us({t}) - epoch_us(date_trunc('second', {t} + INTERVAL 500 MILLISECOND)))"


def _dist(src: str, col: str, p: str = "") -> str:
    """Summary columns of ``col`` over ``src`` with the nearest-rank quantile rule."""
    return f"""(SELECT avg({col}) AS {p}mean,
        (min({col}) FILTER (WHERE i = floor((n - 1) / 2.0)) + min({col}) FILTER (WHERE i = ceil((n - 1) / 2.0))) / 2.0 AS {p}median,
        CAST(min({col}) FILTER (WHERE i = round((n - 1) * 0.25)) AS DOUBLE) AS {p}q25,
        CAST(min({col}) FILTER (WHERE i = round((n - 1) * 0.75)) AS DOUBLE) AS {p}q75,
        CAST(min({col}) AS DOUBLE) AS {p}min, CAST(max({col}) AS DOUBLE) AS {p}max, stddev_samp({col}) AS {p}std
      FROM (SELECT {col}, row_number() OVER (ORDER BY {col}) - 1 AS i, count(*) OVER () AS n FROM {src}))"""


ORACLE["f5_round_delta"] = "SELECT event_id, " + _DELTA.format(t="ts") + " AS delta_us FROM events"
ORACLE["e12_value_histogram"] = ("SELECT " + _DELTA.format(t="ts") + " AS delta_us, count(*) AS count "
                                 "FROM events GROUP BY 1")
ORACLE["e11_distribution_summary"] = ("WITH d AS (SELECT " + _DELTA.format(t="ts") + " AS delta_us FROM events) "
                                      "SELECT round(COLUMNS(*), 4) FROM " + _dist("d", "delta_us"))
ORACLE["e13_row_count"] = "SELECT count(*) AS rows FROM lineitem"


def _profile(name: str, table: str, col: str) -> str:
    return f"""(WITH t AS (SELECT {col} AS ts FROM {table} WHERE {col} IS NOT NULL),
      c AS (SELECT time_bucket(INTERVAL '1 second', ts) AS s, count(*) AS c FROM t GROUP BY 1),
      d AS (SELECT {_DELTA.format(t='ts')} AS dl FROM t),
      a AS {_dist('c', 'c', 'cnt_')}, b AS {_dist('d', 'dl', 'delta_')}
    SELECT '{name}' AS "table", (SELECT count(*) FROM {table}) AS rows, round(COLUMNS(a.*), 4), round(COLUMNS(b.*), 4)
    FROM a, b)"""


ORACLE["i16_quality_profile"] = ("SELECT * FROM " + _profile("events", "events", "ts") + " UNION ALL SELECT * FROM "
                                 + _profile("lineitem", "lineitem", "l_shipdate") + " UNION ALL SELECT * FROM "
                                 + _profile("orders", "orders", "o_orderdate"))

# ----------------------------------------------------------------------------- benchmark grid
V["grid"] = """SELECT CASE l_returnflag WHEN 'A' THEN 'influx' WHEN 'N' THEN 'questdb' ELSE 'timescale' END AS db,
        CAST(l_linenumber * 8 AS INTEGER) AS ram, CASE WHEN l_linestatus = 'F' THEN 8 ELSE 16 END AS cpus,
        l_orderkey * 10 + l_linenumber AS iter, l_extendedprice AS rate FROM lineitem"""
V["gstats"] = """SELECT db, ram, cpus, avg(rate) AS mean, stddev_samp(rate) AS std, count(*) AS n FROM grid GROUP BY ALL"""
_G = with_views("grid", "gstats")

ORACLE["e7_mean_std"] = _G + "x AS (SELECT 1) SELECT db, ram, cpus, n, round(mean, 6) AS mean, round(std, 6) AS std FROM gstats"
ORACLE["e6_pivot_mean"] = _G + """x AS (SELECT 1)
SELECT db, ram, round(avg(mean) FILTER (WHERE cpus = 8), 6) AS cpus_8, round(avg(mean) FILTER (WHERE cpus = 16), 6) AS cpus_16
FROM gstats GROUP BY db, ram"""
ORACLE["e8_argmax_row"] = _G + """x AS (SELECT 1)
SELECT db, ram, cpus, round(mean, 6) AS mean, round(std, 6) AS std FROM (
  SELECT *, row_number() OVER (PARTITION BY db ORDER BY mean DESC, ram, cpus) AS rn FROM gstats) WHERE rn = 1"""
ORACLE["e9_mean_of_means"] = _G + "x AS (SELECT 1) SELECT db, round(avg(mean), 6) AS mean_of_means FROM gstats GROUP BY db"
ORACLE["e10_min_max_mean_scaling"] = _G + """
s AS (SELECT db, cpus, mean / 1e6 AS m FROM gstats),
a AS (SELECT db, min(m) AS min_M, max(m) AS max_M, avg(m) AS mean_M, min(cpus) AS lo, max(cpus) AS hi FROM s GROUP BY db)
SELECT a.db, round(min_M, 9) AS min_M, round(max_M, 9) AS max_M, round(mean_M, 9) AS mean_M,
  round(avg(s.m) FILTER (WHERE s.cpus = a.hi) / nullif(avg(s.m) FILTER (WHERE s.cpus = a.lo), 0), 9) AS scaling
FROM a JOIN s USING (db) GROUP BY a.db, min_M, max_M, mean_M"""
ORACLE["e14_distinct_count"] = with_views("grid") + "x AS (SELECT 1) SELECT count(DISTINCT db) AS n_db FROM grid"
ORACLE["e16_slice_filters"] = _G + """x AS (SELECT 1)
SELECT 'fixed_ram' AS slice, db, ram, cpus, round(mean, 6) AS mean, round(std, 6) AS std FROM gstats WHERE ram = 56
UNION ALL SELECT 'fixed_cpus', db, ram, cpus, round(mean, 6), round(std, 6) FROM gstats WHERE cpus = 16
UNION ALL SELECT 'one_config', db, ram, cpus, round(mean, 6), round(std, 6) FROM gstats WHERE ram = 56 AND cpus = 16"""
ORACLE["i17_benchmark_report"] = _G + """
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY db ORDER BY mean DESC, ram, cpus) AS INTEGER) AS rank FROM gstats)
SELECT db, ram, cpus, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - std, 6) AS band_lo,
       round(mean + std, 6) AS band_hi, round(mean / 1e6, 9) AS throughput_M, rank, rank = 1 AS is_best FROM rk"""
ORACLE["i18_devops_groupby"] = with_views("cpu") + """x AS (SELECT 1)
SELECT host, time_bucket(INTERVAL '1 minute', timestamp) AS minute,
  round(max(usage_user), 6) AS max_usage_user, round(max(usage_system), 6) AS max_usage_system,
  round(max(usage_iowait), 6) AS max_usage_iowait, round(max(usage_idle), 6) AS max_usage_idle,
  round(max(usage_nice), 6) AS max_usage_nice FROM cpu GROUP BY 1, 2"""

ORACLE["a12_tsdb_load_log_scan"] = """
SELECT CASE o_orderstatus WHEN 'F' THEN 'influx' WHEN 'O' THEN 'questdb' ELSE 'timescale' END AS db,
  CAST((o_orderkey % 4 + 1) * 8 AS INTEGER) AS ram, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 16 END AS INTEGER) AS cpus,
  CAST(o_orderkey AS BIGINT) AS iter, round(o_totalprice, 2) AS rows_per_sec, 'metrics/sec' AS unit
FROM orders WHERE o_orderkey % 17 <> 0"""
ORACLE["a13_tsdb_query_log_scan"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'influx' WHEN 'N' THEN 'questdb' ELSE 'timescale' END AS db,
  CAST(l_linenumber * 8 AS INTEGER) AS ram, CAST(CASE WHEN l_linestatus = 'F' THEN 8 ELSE 16 END AS INTEGER) AS cpus,
  CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS iter, CAST(95000 AS BIGINT) AS queries, 8 AS workers,
  l_extendedprice AS rate_qps, round(l_discount * 10, 2) AS min_ms, round(l_quantity / 10, 2) AS med_ms,
  round(l_quantity / 8, 2) AS mean_ms, round(l_quantity * 2, 2) AS max_ms, round(l_tax * 100, 2) AS stddev_ms,
  CAST(185.4 AS DOUBLE) AS sum_s, CAST(95000 AS BIGINT) AS count, round(l_quantity + 20, 2) AS wall_s FROM lineitem"""

_WORDS = "len(regexp_split_to_array(trim(text), '\\s+'))"
ORACLE["a14_llm_request_log_scan"] = f"""
SELECT '/llm/benchmark_' || CAST(conv_id AS VARCHAR) || '.out' AS path, 'model-' || CAST(conv_id % 3 AS VARCHAR) AS model,
  CAST(1000 + turn * 7 AS INTEGER) AS max_tokens, turn + 3 AS prompt_tokens, CAST({_WORDS} AS BIGINT) AS completion_tokens,
  CAST({_WORDS} + turn + 3 AS BIGINT) AS total_tokens, round(length(text) / 100.0, 2) AS seconds FROM conversations"""
ORACLE["i19_llm_request_stats"] = f"""
WITH q AS (SELECT '/llm/benchmark_' || CAST(conv_id AS VARCHAR) || '.out' AS path, 'model-' || CAST(conv_id % 3 AS VARCHAR) AS model,
  turn + 3 AS p, CAST({_WORDS} AS BIGINT) AS c, CAST({_WORDS} + turn + 3 AS BIGINT) AS t, round(length(text) / 100.0, 2) AS s
  FROM conversations)
SELECT path, model, count(*) AS requests, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens,
  CAST(sum(t) AS BIGINT) AS total_tokens, round(sum(t) / nullif(sum(s), 0), 6) AS tokens_per_s, round(avg(s), 6) AS mean_s,
  min(s) AS min_s, max(s) AS max_s FROM q GROUP BY ALL"""

# ----------------------------------------------------------------------------- formats
ORACLE["b7_metric_render"] = f"""
SELECT event_id, 'power,host=' || CAST(user_id AS VARCHAR) || ',event_type=' || event_type || ' value=' || CAST(value AS VARCHAR)
       || ',k=' || CAST({K} AS VARCHAR) || 'i ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line FROM events"""
ORACLE["a16_line_protocol_roundtrip"] = f"""
SELECT user_id AS host, event_type, event_type || ' k=' || CAST({K} AS VARCHAR) || ',x\\' AS label, value, {K} AS k, ts
FROM events"""
ORACLE["a17_pdu_csv_scan"] = f"""
SELECT {DEV} AS connected_device, CAST(user_id % 24 AS VARCHAR) AS outlet_num, event_type AS port,
  CASE WHEN event_type = 'click' THEN CAST(CAST(trunc(value) AS BIGINT) AS DOUBLE) ELSE value END AS value_W,
  event_type = 'click' AS is_int
FROM events WHERE event_type NOT IN ('error', 'view')"""
ORACLE["a18_ipmi_sensor_scan"] = """
SELECT 'node' || CAST(user_id % 8 AS VARCHAR) AS host, 'Temp_' || event_type AS name, 'C' AS unit, value
FROM events WHERE event_type NOT IN ('error', 'view')"""
ORACLE["a19_psu_reading_scan"] = """
SELECT 'node' || CAST(user_id % 8 AS VARCHAR) AS host, CAST(event_id % 3 AS INTEGER) AS psu_id,
  'Instantaneous_Power' AS type, 'W' AS unit, value FROM events WHERE event_type <> 'error'"""
ORACLE["a20_meter_json"] = """
SELECT CAST(user_id % 10 AS INTEGER) AS vcid, event_type AS name, value AS data, 'kW' AS unit,
  CASE WHEN event_type = 'error' THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp,
  CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) END AS ts
FROM events"""
ORACLE["a21_prometheus_text"] = """
SELECT 'Power ' || event_type AS description, CAST(user_id % 10 AS VARCHAR) AS vcID,
  CASE WHEN event_type = 'error' THEN NULL ELSE 'W' END AS unit, value FROM events"""

# ----------------------------------------------------------------------------- scans and lake
ORACLE["a1_telemetry_scan"] = with_views("llm_runs") + """x AS (SELECT 1)
SELECT ts, user_id, value FROM events
WHERE ts BETWEEN (SELECT min(start) FROM llm_runs) AND (SELECT max("end") FROM llm_runs)"""
ORACLE["a6_lazy_scan"] = "SELECT ts FROM events"
ORACLE["a4_tolerant_read"] = "SELECT event_id, ts, user_id, value FROM events"
ORACLE["a5_experiment_scan"] = with_views("llm_runs") + """x AS (SELECT 1)
SELECT ts AS timestamp, CAST(user_id AS VARCHAR) AS SLURM_JOB_ID,
  CASE WHEN event_type = 'signup' THEN 'START' ELSE 'END' END AS status, 'model-' || CAST(user_id % 3 AS VARCHAR) AS notes
FROM events WHERE event_type IN ('signup', 'purchase') AND CAST(user_id AS VARCHAR) IN (SELECT run_id FROM llm_runs)"""
ORACLE["a8_day_sliced_extract"] = "SELECT event_id, ts, user_id, value, CAST(ts AS DATE) AS day FROM events"
ORACLE["a7_lake_range_scan"] = "SELECT event_id, ts, user_id, value FROM events"
ORACLE["b2_day_partitioned_sink"] = "SELECT CAST(ts AS DATE) AS timestamp_day, count(*) AS rows FROM events GROUP BY 1"
ORACLE["b3_append_with_lineage"] = "SELECT 'events.parquet' AS source_file, count(*) AS rows FROM events"
ORACLE["b6_load_report"] = ("SELECT CAST(ts AS DATE) AS timestamp_day, count(*) AS rows, true AS has_files "
                            "FROM events GROUP BY 1")
ORACLE["b1_parquet_sink"] = with_views("pdu", "meter10", "pdu10", "pue") + """x AS (SELECT 1)
SELECT timestamp, round(ratio, 9) AS ratio FROM pue"""
ORACLE["a10_file_checksum_verify"] = """
SELECT f || '.parquet' AS file, CASE WHEN f = 'region' THEN 'mismatch' ELSE 'ok' END AS status
FROM (VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events'),
             ('documents'), ('embeddings'), ('pages'), ('benchmark'), ('labels'), ('conversations')) t(f)"""

# ----------------------------------------------------------------------------- streaming
ORACLE["j1_stream_ingest"] = "SELECT user_id AS host, event_type, value, ts FROM events"
ORACLE["j2_stream_tumbling_power"] = """
SELECT time_bucket(INTERVAL '10 minutes', ts) AS window_start, round(avg(value), 6) AS mean_W, count(*) AS n
FROM events GROUP BY 1
HAVING time_bucket(INTERVAL '10 minutes', ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
ORACLE["j4_stream_energy"] = with_views("machine_power") + _trapezoid("machine_power", "host", "value") + """
SELECT host, round(sum(p_avg * dt_s) FILTER (WHERE dt_s > 0), 6) AS energy_J,
       round(sum(p_avg * dt_s) FILTER (WHERE dt_s > 0) / 3600.0, 6) AS energy_Wh,
       count(*) + 1 AS samples, CAST(0 AS BIGINT) AS late_samples
FROM iv GROUP BY host"""
ORACLE["j3_stream_counter_rate"] = with_views("diskio") + """x AS (SELECT 1)
SELECT host, timestamp, coalesce(greatest(CAST(reads AS DOUBLE) - lag(reads) OVER (PARTITION BY host ORDER BY timestamp), 0.0), 0.0) AS rate
FROM diskio"""
ORACLE["j5_stream_pue"] = with_views("pdu", "meter10", "pdu10", "pue") + """x AS (SELECT 1)
SELECT timestamp, round(ratio, 9) AS ratio FROM pue
WHERE timestamp + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""

# ----------------------------------------------------------------------------- building blocks
ORACLE["a15_llm_run_log_scan"] = """
WITH l AS (SELECT user_id, arg_max(event_id, event_id) AS n FROM events GROUP BY user_id),
m AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'signup') AS starts,
             count(*) FILTER (WHERE event_type = 'purchase') AS ends FROM events GROUP BY user_id)
SELECT '/llm/run_' || CAST(l.user_id AS VARCHAR) || '.err' AS path, n AS requests, n % 7 AS failures,
  round(1.0 * (n % 7) / greatest(n, 1) * 100, 2) AS failure_pct, n % 1000 AS avg_ms, n % 900 AS med_ms,
  CASE WHEN starts + ends > 0 THEN starts END AS starts, CASE WHEN starts + ends > 0 THEN ends END AS ends
FROM l JOIN m USING (user_id)"""
ORACLE["c3_equality_filters"] = "SELECT ts AS timestamp, value * 50 AS value FROM events WHERE event_type = 'view'"
ORACLE["c6_rollup_row_filter"] = """SELECT ts AS timestamp, user_id AS host, value AS package_power_watt
FROM events WHERE event_type IN ('view', 'click')"""
ORACLE["c7_drop_nulls"] = with_views("ior_marks") + """x AS (SELECT 1)
SELECT backend, scenario, iter FROM ior_marks GROUP BY ALL
HAVING min(timestamp) FILTER (WHERE status = 'START') IS NOT NULL AND min(timestamp) FILTER (WHERE status = 'END') IS NOT NULL"""
ORACLE["c10_case_when"] = with_views("ipmi", "spw") + """x AS (SELECT 1)
SELECT time_bucket(INTERVAL '1 second', timestamp) AS ts,
  round(CASE WHEN sum(value) - 100.0 > 0 THEN 1000.0 / (sum(value) - 100.0) END, 6) AS ratio FROM spw GROUP BY 1"""
ORACLE["c11_finite_guard"] = with_views("grid", "gstats") + """x AS (SELECT 1)
SELECT db, ram, cpus, round(coalesce(CASE WHEN isfinite(mean / nullif(std, 0)) THEN mean / nullif(std, 0) END, 0.0), 6) AS ratio
FROM gstats"""
ORACLE["c12_clip_fill"] = with_views("diskio") + """x AS (SELECT 1)
SELECT host, timestamp, name, coalesce(greatest(reads - lag(reads) OVER (PARTITION BY host ORDER BY timestamp, name), 0), 0) AS reads_rate
FROM diskio"""
ORACLE["c13_empty_summary"] = "SELECT avg(value) AS mean_value, max(ts) AS last_ts, count(*) AS n FROM events WHERE value < 0"
ORACLE["d1_bucket_equi_join"] = with_views("diskio", "ipmi", "spw") + _disk_rates_sql("diskio", "") + """,
pw AS (SELECT time_bucket(INTERVAL '1 second', timestamp) AS ts, sum(value) AS w FROM spw GROUP BY 1)
SELECT ts, reads_rate, round(w, 6) AS total_power_W FROM dm JOIN pw USING (ts)"""
ORACLE["d2_dimension_equi_join"] = with_views("ior_marks", "ior_rows", "ior_perf") + """
g AS (SELECT DISTINCT backend, scenario FROM ior_marks)
SELECT g.backend, g.scenario, p.fs_type, round(p.bw_MiB, 6) AS bw_MiB FROM g JOIN ior_perf p
  ON p.scenario = g.scenario AND p.api = g.backend"""
ORACLE["d7_series_add_align"] = with_views("pdu", "ipmi") + """
missing AS (SELECT DISTINCT connected_device FROM pdu EXCEPT SELECT DISTINCT split_part(host, '.', 1) FROM ipmi),
mp AS (SELECT timestamp, sum(value_W) AS w FROM (
        SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, connected_device, port, avg(value_W) AS value_W
        FROM pdu WHERE connected_device IN (SELECT * FROM missing) GROUP BY 1, 2, 3) GROUP BY 1),
ip AS (SELECT timestamp, coalesce(sum(v), 0) AS w FROM (
        SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, host,
               avg(value) FILTER (WHERE psu_id = '0' AND unit = 'W') AS v FROM ipmi GROUP BY 1, 2) GROUP BY 1)
SELECT timestamp, round(ip.w + mp.w, 6) AS total_W FROM ip JOIN mp USING (timestamp)"""
ORACLE["d8_vertical_concat"] = """
SELECT CASE l_returnflag WHEN 'A' THEN 'influx' WHEN 'N' THEN 'questdb' ELSE 'timescale' END AS db,
  count(*) AS logs, round(avg(l_extendedprice), 6) AS mean_rate FROM lineitem GROUP BY 1"""
ORACLE["d9_distinct_values"] = with_views("net") + "x AS (SELECT 1) SELECT DISTINCT host, interface FROM net"
ORACLE["e1_group_sum_mean"] = with_views("ipmi") + """x AS (SELECT 1)
SELECT host, psu_id, round(coalesce(sum(value) FILTER (WHERE unit = 'W'), 0), 6) AS sum_W,
  round(avg(value) FILTER (WHERE unit = 'W'), 6) AS mean_W FROM ipmi GROUP BY ALL"""
ORACLE["e2_global_mean"] = "SELECT round(avg(value), 6) AS mean_value, round(avg(length(props)), 6) AS mean_props_len FROM events"
ORACLE["f3_truncate_bucket"] = """
SELECT date_trunc('second', ts) AS second, time_bucket(INTERVAL '5 minutes', ts) AS five_min, count(*) AS n
FROM events GROUP BY 1, 2"""
ORACLE["f6_lag_1"] = with_views("gpu") + """x AS (SELECT 1)
SELECT event_id, "index", lag(power_draw) OVER (PARTITION BY "index" ORDER BY timestamp, event_id) AS prev_power_draw FROM gpu"""
ORACLE["f7_diff"] = """
WITH s AS (SELECT time_bucket(INTERVAL '1 second', ts) AS ts, sum(value * 50) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT ts, round(v - lag(v) OVER (ORDER BY ts), 6) AS value_diff FROM s"""
ORACLE["g1_multi_key_sort"] = ORACLE["i12_efficiency_comparison"] + "\nORDER BY backend, scenario"
ORACLE["g2_desc_sort"] = ORACLE["e7_mean_std"] + "\nORDER BY mean DESC, db, ram, cpus"
ORACLE["g3_head_n"] = ORACLE["i3_integrate_power_by_host"] + "\nORDER BY energy_J DESC, host LIMIT 5"
ORACLE["h4_split_first"] = with_views("ipmi") + "x AS (SELECT 1) SELECT DISTINCT host, split_part(host, '.', 1) AS short FROM ipmi"
ORACLE["h6_timezone_convert"] = """
SELECT event_id, CAST(timezone('UTC', timezone('Europe/Rome', ts)) AS TIMESTAMP) AS utc,
  CAST(timezone('Europe/Rome', timezone('UTC', ts)) AS TIMESTAMP) AS rome FROM events"""

ORACLE["a4_skipped_files"] = """
SELECT * FROM (VALUES ('unreadable or empty', 1::BIGINT), ('no value of value', 1::BIGINT)) t(reason, files)
WHERE EXISTS (SELECT 1 FROM events WHERE event_id < 10)"""

# ----------------------------------------------------------------------------- runs over several hosts
V["cluster_runs"] = """SELECT 'run-' || CAST(host % 5 AS VARCHAR) AS run_id, host, 'model-' || CAST(host % 5 AS VARCHAR) AS model,
        min(start) OVER (PARTITION BY host % 5) AS start, max("end") OVER (PARTITION BY host % 5) AS "end" FROM llm_runs"""


def _energy_by(src: str, keys: str, cols: str, where: str = "TRUE") -> str:
    """SELECT of (keys, wh per column) of the series inside cluster runs, by trapezoids."""
    lags = ", ".join(f"{c}, lag({c}) OVER w AS p_{c}" for c in cols.split())
    sums = ", ".join(f"sum(({c} + p_{c}) / 2.0 * dt_s / 3600.0) AS wh_{c}" for c in cols.split())
    return f"""SELECT {keys}, {sums} FROM (
        SELECT *, ((epoch_us(ts) - epoch_us(pts)) // 1000) / 1000.0 AS dt_s FROM (
          SELECT {keys}, x.timestamp AS ts, lag(x.timestamp) OVER w AS pts, {lags}
          FROM {src} x JOIN cluster_runs c ON x.host = c.host AND x.timestamp BETWEEN c.start AND c."end" WHERE {where}
          WINDOW w AS (PARTITION BY {keys} ORDER BY x.timestamp, x.event_id))) WHERE dt_s > 0 GROUP BY {keys}"""


_CLUSTER_SPLIT = """
u AS (SELECT c.run_id, x.host, x."index", avg(utilization_gpu) AS u FROM gpu x JOIN cluster_runs c
      ON x.host = c.host AND x.timestamp BETWEEN c.start AND c."end" GROUP BY ALL),
e AS (""" + _energy_by("gpu", 'c.run_id, x.host, x."index"', "power_draw").replace("SELECT c.run_id, x.host, x.\"index\", sum", 'SELECT run_id, host, "index", sum', 1).replace('GROUP BY c.run_id, x.host, x."index"', 'GROUP BY run_id, host, "index"') + """),
split AS (SELECT u.run_id, count(*) FILTER (WHERE u >= 1.0) AS active_gpus, avg(u) FILTER (WHERE u >= 1.0) AS avg_active_util,
    coalesce(sum(wh_power_draw) FILTER (WHERE u >= 1.0), 0.0) AS active_gpu_Wh, count(*) FILTER (WHERE u < 1.0) AS inactive_gpus,
    avg(u) FILTER (WHERE u < 1.0) AS avg_inactive_util, coalesce(sum(wh_power_draw) FILTER (WHERE u < 1.0), 0.0) AS inactive_gpu_Wh
  FROM u LEFT JOIN e USING (run_id, host, "index") GROUP BY u.run_id)"""


def _per_host(src: str, cols: str, where: str) -> str:
    return _energy_by(src, "c.run_id, x.host", cols, where).replace("SELECT c.run_id, x.host, sum", "SELECT run_id, host, sum", 1).replace("GROUP BY c.run_id, x.host", "GROUP BY run_id, host")


ORACLE["i5_multi_host"] = with_views("llm_runs", "cluster_runs", "gpu") + _CLUSTER_SPLIT + """
SELECT run_id, active_gpus, round(avg_active_util, 6) AS avg_active_util, round(active_gpu_Wh, 4) AS active_gpu_Wh,
       inactive_gpus, round(avg_inactive_util, 6) AS avg_inactive_util, round(inactive_gpu_Wh, 4) AS inactive_gpu_Wh FROM split"""
ORACLE["i5_no_index"] = with_views("llm_runs", "cluster_runs", "gpu") + """
u AS (SELECT c.run_id, x.host, avg(utilization_gpu) AS u FROM gpu x JOIN cluster_runs c
      ON x.host = c.host AND x.timestamp BETWEEN c.start AND c."end" GROUP BY ALL),
e AS (""" + _per_host("gpu", "power_draw", "TRUE") + """)
SELECT u.run_id, count(*) AS active_gpus, round(avg(u), 6) AS avg_active_util,
       round(coalesce(sum(wh_power_draw), 0.0), 4) AS active_gpu_Wh, CAST(0 AS BIGINT) AS inactive_gpus
FROM u LEFT JOIN e USING (run_id, host) GROUP BY u.run_id"""
ORACLE["i6_multi_host"] = with_views("llm_runs", "cluster_runs", "gpu", "machine_power", "turbostat", "pdu", "meter10", "pdu10", "pue") + _CLUSTER_SPLIT + f""",
tok AS (SELECT c.run_id, sum({K} * 10) AS t FROM events e JOIN cluster_runs c ON e.user_id = c.host AND e.ts BETWEEN c.start AND c."end" GROUP BY c.run_id),
sy AS (SELECT run_id, sum(wh_value) AS sys_wh FROM (""" + _per_host("machine_power", "value", "x.psu_id = '0' AND x.unit = 'W'") + """) GROUP BY run_id),
cp AS (SELECT run_id, sum(wh_package_power_watt + wh_ram_power_watt) AS cpu_wh FROM (""" + _per_host("turbostat", "package_power_watt ram_power_watt", "x.die = '-'") + """) GROUP BY run_id),
cr AS (SELECT DISTINCT run_id, model, start, "end" FROM cluster_runs),
ap AS (SELECT cr.run_id, avg(p.ratio) AS avg_pue FROM pue p JOIN cr ON p.timestamp BETWEEN cr.start AND cr."end" GROUP BY cr.run_id)
SELECT run_id, model, active_gpus, round(t / ((epoch_us("end") - epoch_us(start)) / 1000000.0), 5) AS tokens_per_s,
  round(avg_active_util, 5) AS avg_active_gpu_util, round(active_gpu_Wh / t * 1000.0, 5) AS active_gpu_Wh_per_1k,
  round(inactive_gpu_Wh / t * 1000.0, 5) AS inactive_gpu_Wh_per_1k, round(cpu_wh / t * 1000.0, 5) AS cpu_Wh_per_1k,
  round(sys_wh / t * 1000.0, 5) AS system_Wh_per_1k, round(sys_wh / t * avg_pue * 1000.0, 5) AS adjusted_Wh_per_1k
FROM cr JOIN split USING (run_id) JOIN tok USING (run_id) LEFT JOIN sy USING (run_id) LEFT JOIN cp USING (run_id) LEFT JOIN ap USING (run_id)
WHERE active_gpus > 0 AND t > 0"""


# ----------------------------------------------------------------------------- further building blocks
ORACLE["i16_quality_histogram"] = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count, count(*) AS seconds FROM (SELECT count(*) AS count FROM {t} GROUP BY time_bucket(INTERVAL '1 second', CAST({c} AS TIMESTAMP))) GROUP BY count"
    for t, c in (("events", "ts"), ("lineitem", "l_shipdate"), ("orders", "o_orderdate")))
ORACLE["h6_ensure_utc"] = """
SELECT event_id, kind, CASE WHEN kind = 'text' AND event_type = 'error' THEN NULL ELSE ts END AS timestamp
FROM events, (VALUES ('text'), ('naive'), ('zoned')) k(kind)"""
ORACLE["i19_latency_percentiles"] = """
WITH q AS (SELECT 'model-' || CAST(conv_id % 3 AS VARCHAR) AS model, round(length(text) / 100.0, 2) AS s FROM conversations),
l AS (SELECT model, count(*) AS requests, list_sort(list(s)) AS v FROM q GROUP BY model)
SELECT model, requests, """ + ", ".join(f"v[CAST(round((requests - 1) * {q}) AS BIGINT) + 1] AS p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99)) + " FROM l"
ORACLE["a5_experiment_by_id"] = """
SELECT ts AS timestamp, CASE WHEN event_type = 'signup' THEN 'START' ELSE 'END' END AS status,
  CASE WHEN user_id % 11 = 0 THEN 'IOR-idle' ELSE 'IOR-backend=' || CASE WHEN user_id % 2 = 0 THEN 'posix' ELSE 'mpiio' END || '-scenario='
    || ['write_seq_4m','read_seq_4m','write_seq_4k','read_seq_4k','write_rand_4k','read_rand_4k','writeread_rand_4k_shared'][CAST((user_id // 2) % 7 AS INTEGER) + 1]
    || '_' || CAST(user_id AS VARCHAR) END AS notes
FROM events WHERE event_type IN ('signup', 'purchase')"""
ORACLE["b4_load_modes"] = """
SELECT CAST(step AS BIGINT) AS step, mode, CAST(f * (SELECT count(*) FROM events) AS BIGINT) AS rows
FROM (VALUES (0, 'create', 1), (1, 'append', 2), (2, 'skip', 2), (3, 'replace', 1)) m(step, mode, f)"""
ORACLE["b7_render_formats"] = """
SELECT event_id, event_id || ',' || event_type || ',' || user_id AS csv,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '","host":' || user_id || '}' AS json,
  '# Power ' || event_type || chr(10) || 'vcId_' || (user_id % 10) || '{unit="W"} ' || user_id AS prometheus FROM events"""
ORACLE["a10_index_records"] = """
SELECT l_linestatus AS "table", l_returnflag AS label, l_orderkey || '-' || l_linenumber AS record_id FROM lineitem"""
ORACLE["a15_run_percentiles"] = """
WITH l AS (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id)
SELECT '/llm/run_' || user_id || '.err' AS path, m % 1000 AS p50, m % 1000 + 70 AS p99, m % 1000 + 100 AS p100, m AS n FROM l"""
ORACLE["a15_run_errors"] = """
WITH l AS (SELECT user_id, max(event_id) AS m FROM events GROUP BY user_id)
SELECT '/llm/run_' || user_id || '.err' AS path, m % 50 + 1 AS occurrences, 'POST /v1: timed out' AS error FROM l"""
ORACLE["a2_file_time_pruning"] = """
WITH r AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
SELECT event_id, ts, value FROM events, r
WHERE epoch_us(ts) BETWEEN lo + round((hi - lo) / 4.0) AND hi - round((hi - lo) / 4.0)"""
ORACLE["a8_day_files"] = """
WITH r AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)
SELECT CAST(ts AS DATE) AS day, count(*) AS rows, round(sum(value), 4) AS total FROM events, r
WHERE epoch_us(ts) BETWEEN lo + round((hi - lo) / 4.0) AND hi - round((hi - lo) / 4.0) GROUP BY 1"""
ORACLE["j1_stream_day_files"] = "SELECT user_id, count(*) AS rows, round(sum(value), 4) AS total FROM events GROUP BY user_id"

# ----------------------------------------------------------------------------- snapshot tables
ORACLE["b3_snapshot_lineage"] = """SELECT 'weekday' || (dayofweek(ts) + 1) AS source_file, count(*) AS rows, CAST((dayofweek(ts) + 1) // 2 + 1 AS BIGINT) AS version
FROM events GROUP BY dayofweek(ts)"""
ORACLE["b4_snapshot_history"] = """
WITH e AS (SELECT *, (dayofweek(ts) + 1) // 2 + 1 AS v FROM events),
s(version, parent, operation) AS (VALUES (1, NULL, 'create'), (2, 1, 'append'), (3, 2, 'append'), (4, 3, 'append'), (5, 4, 'replace'), (6, 5, 'rollback'))
SELECT CAST(version AS BIGINT) AS version, CAST(parent AS BIGINT) AS parent, operation, count(*) AS n, count(*) AS rows, round(sum(value), 4) AS total
FROM s JOIN e ON CASE version WHEN 5 THEN event_type = 'view' ELSE v <= version END GROUP BY ALL"""
ORACLE["a7_snapshot_scan"] = """
WITH r AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)
SELECT event_id, ts, user_id, value FROM events, r WHERE event_type IN ('signup', 'purchase')
AND epoch_us(ts) >= lo + round((hi - lo) / 3.0) AND epoch_us(ts) < lo + round((hi - lo) * 2 / 3.0)"""
ORACLE["a7_host_lookup"] = """SELECT event_id, ts, user_id, value FROM events
WHERE user_id = (SELECT user_id FROM events ORDER BY value DESC NULLS LAST, user_id DESC LIMIT 1)"""
ORACLE["b6_planned_files"] = """SELECT CAST(count(*) AS BIGINT) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, min(user_id) AS first_host, max(user_id) AS last_host,
CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS null_values FROM events"""

# ----------------------------------------------------------------------------- streams in event order
#: the watermark after all samples of ``events``, in whole milliseconds: two fifths of the time (and up to a second) behind
_FINAL = """final AS (SELECT (max(epoch_us(ts)) + 999) // 1000 - 1000 * (CAST(floor(2 * greatest((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 / 5, 1.0)) AS BIGINT) + 1) AS ms FROM events)"""
ORACLE["j4_stream_energy_shuffled"] = with_views("machine_power") + _FINAL + ", power AS (SELECT machine_power.* FROM machine_power, final WHERE epoch_us(timestamp) <= ms * 1000), " + _trapezoid("power", "host", "value", "value") + """
SELECT host, round(coalesce(any_value(j), 0), 6) AS energy_J, count(*) AS samples, CAST(0 AS BIGINT) AS late_samples
FROM power LEFT JOIN (SELECT host, sum(p_avg * dt_s) AS j FROM iv WHERE dt_s > 0 GROUP BY host) USING (host) GROUP BY host"""
ORACLE["j3_stream_counter_rate_shuffled"] = with_views("diskio") + _FINAL + """
SELECT host, timestamp, coalesce(greatest(CAST(reads AS DOUBLE) - lag(reads) OVER (PARTITION BY host ORDER BY timestamp, reads), 0.0), 0.0) AS rate, false AS late
FROM diskio, final WHERE epoch_us(timestamp) <= ms * 1000"""
ORACLE["j5_stream_pue_join"] = with_views("pdu", "meter10", "pdu10", "pue") + """x AS (SELECT least(max(ts) FILTER (WHERE event_type = 'view'), max(ts) FILTER (WHERE event_type != 'view')) AS seen FROM events)
SELECT timestamp, round(ratio, 9) AS ratio FROM pue, x WHERE timestamp + INTERVAL 20 MINUTE <= seen"""

# ----------------------------------------------------------------------------- other forms of the same
ORACLE["f6_lag_depth"] = ORACLE["f6_lag_1"]
ORACLE["d4_dyadic_join"] = ORACLE["d4_run_window_join"]

# ----------------------------------------------------------------------------- rollups and sketches
ORACLE["i18_stream_rollup"] = ORACLE["i18_devops_groupby"]
ORACLE["f1_rollup_range"] = with_views("machine_power") + """r AS (SELECT epoch_us(min(timestamp)) AS lo, epoch_us(max(timestamp)) AS hi FROM machine_power)
SELECT time_bucket(INTERVAL '10 minutes', timestamp) AS timestamp, host, count(*) AS rows, count(value) AS n, round(sum(value), 6) AS total,
round(avg(value), 6) AS mean, round(min(value), 6) AS low, round(max(value), 6) AS high FROM machine_power, r
WHERE timestamp >= date_trunc('hour', make_timestamp(CAST(round(lo + (hi - lo) / 3.0) AS BIGINT))) AND timestamp < date_trunc('hour', make_timestamp(CAST(round(lo + (hi - lo) * 2 / 3.0) AS BIGINT))) GROUP BY 1, 2"""
ORACLE["e11_sketch_summary"] = """WITH x AS (SELECT 'value' AS col, value AS v FROM events UNION ALL SELECT 'host', CAST(user_id AS DOUBLE) FROM events)
SELECT col, count(v) AS n, CAST(count(*) - count(v) AS BIGINT) AS nulls, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
true AS ranks_near, true AS distinct_near FROM x GROUP BY col"""
