"""Telemetry text formats: parse (A16-A21) and render.

Inputs are line corpora ``(path, line_no, line)`` (see
:func:`wattspark.sources.textlogs.read_lines`) or single-column text frames.
Every parser is a projection of Spark string / regex / JSON functions; the only
ordered step (Prometheus descriptions, A21) is a window per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wattspark.functions.safe import nullif_empty
from wattspark.functions.timecols import epoch_us

# ----------------------------------------------------------------------------- line protocol
# A token is a run of non-separator characters, where "\x" escapes any character
# and a double-quoted string (field values) may contain separators.
_TOKEN = r'((?:"(?:[^"\\]|\\.)*"|[^ \\"]|\\.|")+)'  # a quote that nothing closes is a character
_ITEM = r'((?:"(?:[^"\\]|\\.)*"|[^,\\"]|\\.|")+)'
_KEY = r'^((?:[^=\\]|\\.)+)='


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def _kv_map(items: Column, unescape_values: bool) -> Column:
    """array of 'k=v' (escaped) -> map<k, v>; keys always unescaped, values on request (tags)."""
    def entry(kv):
        v = F.substring(kv, F.length(F.regexp_extract(kv, _KEY, 0)) + 1, 1 << 30)
        return F.struct(_unescape(F.regexp_extract(kv, _KEY, 1)).alias("key"),
                        (_unescape(v) if unescape_values else v).alias("value"))
    return _last_wins(F.transform(items, entry))


def _last_wins(entries: Column) -> Column:
    """Map of key-value entries; of a repeated key the last one counts."""
    keys = F.reverse(F.transform(entries, lambda x: x["key"]))
    return F.map_from_entries(F.filter(entries, lambda x, i: F.array_position(keys, x["key"]) == F.size(entries) - i))


def _plain_map(s: Column) -> Column:
    """``k=v,k=v`` without escapes or quotes -> map (code-generated ``str_to_map``, unless a key is repeated)."""
    keys = F.split(s, "(=[^,]*)?(,|$)")
    split = F.transform(F.split(s, ","), lambda kv: F.struct(F.substring_index(kv, "=", 1).alias("key"), F.when(kv.contains("="), F.substring(kv, F.instr(kv, "=") + 1, F.length(kv))).alias("value")))
    return (F.when(s == "", F.create_map().cast("map<string,string>"))
            .when(~s.contains(",") | (F.size(F.array_distinct(keys)) == F.size(keys)), F.str_to_map(s, F.lit(","), F.lit("="))).otherwise(_last_wins(split)))


# a tag: escape pairs (so an escaped backslash never escapes what follows it) and other characters
_TAG = r"((?:[^,\\]|\\.)+)"


def _escaped_tag_map(s: Column) -> Column:
    """Tag set with escapes: tokenised into ``k=v`` items, escapes removed from keys and values."""
    return F.when(s == "", F.create_map().cast("map<string,string>")).otherwise(
        _kv_map(F.regexp_extract_all(s, F.lit(_TAG), 1), True))


def parse_line_protocol(df: DataFrame, col: str = "line") -> DataFrame:
    """``measurement,tag=v,... field=v,... [ns]`` -> measurement, tags, fields, time.

    ``tags``: map<string,string> (unescaped); ``fields``: map<string,string> of raw
    field tokens (see :func:`field_double` / :func:`field_long`); ``time``:
    TIMESTAMP_NTZ from the nanosecond epoch or NULL. Blank and comment lines and
    lines without fields are dropped. Of a repeated tag or field key the last value counts; a quote
    that is not closed is a plain character.

    Lines without a backslash or a double quote (nearly all collector output)
    take a code-generated path (``split`` + ``str_to_map``); the others are
    tokenised by escape-aware regular expressions.
    """
    line = F.col(col)
    d = df.where(line.isNotNull() & (F.trim(line) != "") & ~F.trim(line).startswith("#"))
    simple = ~line.contains("\\") & ~line.contains('"')
    d = d.withColumn("__simple", simple).withColumn(
        "__tok", F.when(F.col("__simple"), F.split(F.trim(line), " +"))
                  .otherwise(F.regexp_extract_all(line, F.lit(_TOKEN), 1)))
    d = d.where(F.size("__tok") >= 2)
    series, fields = F.col("__tok")[0], F.col("__tok")[1]
    meas_plain = F.substring_index(series, ",", 1)
    tags_plain = F.substring(series, F.length(meas_plain) + 2, 1 << 30)
    meas_esc = F.regexp_extract(series, r"^((?:[^,\\]|\\.)*)", 1)
    tags_esc = F.substring(series, F.length(meas_esc) + 2, 1 << 30)
    d = d.withColumn("__ns", F.try_element_at("__tok", F.lit(3)).try_cast("bigint"))
    keep = [c for c in df.columns if c != col]
    return d.select(
        *keep,
        F.when(F.col("__simple"), meas_plain).otherwise(_unescape(meas_esc)).alias("measurement"),
        F.when(F.col("__simple"), _plain_map(tags_plain)).otherwise(_escaped_tag_map(tags_esc)).alias("tags"),
        F.when(~fields.contains('"') & ~fields.contains("\\"), _plain_map(fields))
         .otherwise(_kv_map(F.regexp_extract_all(fields, F.lit(_ITEM), 1), False)).alias("fields"),
        # integer division: a nanosecond epoch does not fit a double exactly
        F.timestamp_micros(F.expr("__ns div 1000")).cast("timestamp_ntz").alias("time"))


def field_double(fields: str, name: str) -> Column:
    """Numeric field as double (``42i`` integers included)."""
    v = F.col(fields)[name]
    return F.regexp_replace(v, "i$", "").try_cast("double")


def field_long(fields: str, name: str) -> Column:
    """Integer field (``42i``) as bigint; floats give NULL."""
    v = F.col(fields)[name]
    return F.when(v.rlike(r"^-?\d+i$"), F.regexp_replace(v, "i$", "").try_cast("bigint"))


def field_string(fields: str, name: str) -> Column:
    """Quoted string field with escapes removed; NULL if the quote is not closed."""
    v = F.col(fields)[name]
    return F.when(v.rlike(r'(?s)^".*"$'), _unescape(F.regexp_extract(v, r'(?s)^"(.*)"$', 1)))


def escape_tag(c: Column) -> Column:
    """Tag key/value escaping: backslash, space, comma, equals."""
    return F.regexp_replace(c, r"([\\ ,=])", r"\\$1")


def render_line_protocol(df: DataFrame, measurement: str, tags: Sequence[str], fields: dict[str, str],
                         time_col: str | None = None) -> Column:
    """A line-protocol string column.

    ``fields``: name -> 'int' | 'float' | 'str'. Integers get the ``i`` suffix,
    strings are quoted; NULL tags / fields are omitted; time in ns.
    """
    tag_parts = [F.when(F.col(t).isNotNull(), F.concat(F.lit("," + t + "="), escape_tag(F.col(t).cast("string"))))
                 for t in tags]
    fparts = []
    for name, ty in fields.items():
        v = F.col(name)
        if ty == "int":
            s = F.concat(v.cast("bigint").cast("string"), F.lit("i"))
        elif ty == "str":
            s = F.concat(F.lit('"'), F.regexp_replace(v.cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
        else:
            s = v.cast("double").cast("string")
        fparts.append(F.when(v.isNotNull(), F.concat(F.lit(name + "="), s)))
    line = F.concat(F.lit(measurement), F.concat_ws("", *[F.coalesce(p, F.lit("")) for p in tag_parts]),
                    F.lit(" "), F.concat_ws(",", *fparts))
    if time_col:
        line = F.concat(line, F.lit(" "), (epoch_us(time_col) * 1000).cast("string"))
    return line


# ----------------------------------------------------------------------------- A17 PDU CSV
def parse_pdu_csv(lines: DataFrame) -> DataFrame:
    """``pdu-name,outlet,connected-device,port,value`` lines, header (line 1) skipped.

    CR stripped from the value; empty and ``null`` values dropped; ``is_int``
    marks integer readings (rendered with the ``i`` suffix downstream).
    """
    parts = F.split(F.col("line"), ",")
    val = F.regexp_replace(parts[4], "\r$", "")
    d = lines.where(F.col("line_no") > 1).select(
        "path", "line_no", parts[0].alias("pdu"), parts[1].alias("outlet_num"),
        parts[2].alias("connected_device"), parts[3].alias("port"), val.alias("__v"))
    d = d.where(F.col("__v").isNotNull() & (F.col("__v") != "") & (F.col("__v") != "null"))
    return d.select("path", "line_no", "pdu", "outlet_num", "connected_device", "port",
                    F.col("__v").try_cast("double").alias("value_W"),
                    F.col("__v").rlike(r"^-?[0-9]+$").alias("is_int"))


# ----------------------------------------------------------------------------- A18 sensors
def parse_ipmi_sensor_csv(lines: DataFrame, host: Column | str = "host") -> DataFrame:
    """``ID,Name,Reading,Units,State`` with quotes removed; spaces -> '_' in the name;
    rows whose reading or unit is ``N/A`` are dropped."""
    clean = F.translate(F.col("line"), "'", "")
    parts = F.split(clean, ",")
    h = F.col(host) if isinstance(host, str) else host
    d = lines.select("path", "line_no", h.alias("host"),
                     F.regexp_replace(parts[1], " ", "_").alias("name"),
                     parts[2].alias("__v"), parts[3].alias("unit"))
    d = d.where((F.col("unit") != "N/A") & (F.col("__v") != "N/A"))
    return d.select("path", "line_no", "host", "name", "unit", F.col("__v").try_cast("double").alias("value"))


# ----------------------------------------------------------------------------- A19 PSU
def parse_psu_readings(lines: DataFrame, psu_col: str = "psu_id", host: Column | str = "host") -> DataFrame:
    """``Key Name : 5 W`` -> type=Key_Name, value, unit; only ``^[0-9.]+$`` values kept."""
    parts = F.split(F.col("line"), ":")
    key = F.regexp_replace(F.trim(parts[0]), " ", "_")
    raw = F.split(F.trim(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))), " ")
    h = F.col(host) if isinstance(host, str) else host
    d = lines.select("path", "line_no", h.alias("host"), F.col(psu_col).alias("psu_id"),
                     key.alias("type"), raw[0].alias("__v"), F.try_element_at(raw, F.lit(2)).alias("unit"))
    d = d.where(F.col("__v").rlike(r"^[0-9.]+$"))
    return d.select("path", "line_no", "host", "psu_id", "type", "unit",
                    F.col("__v").try_cast("double").alias("value"))


# ----------------------------------------------------------------------------- A20 meter JSON
_METER_OBJ = "struct<name:string,data:double,unit:struct<unit:string>,lastUpdate:string>"
# Fixed value: the meter's time layout.
METER_TIME = "ddMMyyyyHHmmss"


def meter_time(c: Column) -> Column:
    """The first 14 characters read in the meter's layout; NULL when they are no such time."""
    return F.try_to_timestamp(F.substring(c, 1, len(METER_TIME)), F.lit(METER_TIME)).cast("timestamp_ntz")


def meter_time_iso(c: Column) -> Column:
    """Meter time -> ``yyyy-MM-ddTHH:mm:ss`` text; ``""`` when it is no time."""
    return F.coalesce(F.date_format(meter_time(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def parse_meter_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """``{"vcIds": [...], "v<id>": {name, data, unit: {unit}, lastUpdate}}`` -> one row per id.

    Ids that are not integers, or whose ``v<id>`` object is absent, are dropped.
    ``timestamp`` is ISO text ('' if the meter time is malformed); ``ts`` its typed value.
    """
    m = F.from_json(F.col(col), "map<string,string>")
    d = df.select("*", m.alias("__m"))
    ids = F.from_json(F.col("__m")["vcIds"], "array<string>")
    d = d.select("*", F.explode(ids).alias("__id"))
    d = d.withColumn("__n", F.trim(F.col("__id")).try_cast("int"))
    d = d.where(F.col("__n").isNotNull())
    key = F.concat(F.lit("v"), F.col("__n").cast("string"))
    d = d.where(F.map_contains_key("__m", key))
    obj = F.from_json(F.col("__m")[key], _METER_OBJ)
    d = d.withColumn("__o", obj)
    iso = meter_time_iso(F.col("__o.lastUpdate"))
    keep = [c for c in df.columns if c != col]
    return d.select(*keep, F.col("__n").alias("vcid"), F.col("__o.name").alias("name"),
                    F.col("__o.data").alias("data"), F.col("__o.unit.unit").alias("unit"),
                    iso.alias("timestamp"),
                    meter_time(F.col("__o.lastUpdate")).alias("ts"))


# ----------------------------------------------------------------------------- A21 Prometheus
def parse_prometheus_text(lines: DataFrame) -> DataFrame:
    """A ``# description`` line applies to the following ``vcId_<n>{unit="u"} v`` lines
    of the same file; an empty unit yields a NULL unit (the tag is omitted)."""
    l = F.col("line")
    is_desc = l.rlike(r"^\s*#")
    desc = F.when(is_desc, F.regexp_replace(l, r"^\s*#\s*", ""))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumn("__d", F.last(desc, ignorenulls=True).over(w))
    d = d.where(l.rlike(r"^vcId_[0-9]+"))
    unit = nullif_empty(F.regexp_extract(l, r'unit="([^"]*)"', 1))
    parts = F.split(F.trim(l), r"\s+")
    return d.select("path", "line_no", F.coalesce(F.col("__d"), F.lit("")).alias("description"),
                    F.regexp_extract(l, r"^vcId_([0-9]+)", 1).alias("vcID"), unit.alias("unit"),
                    F.element_at(parts, -1).try_cast("double").alias("value"))


def render_prometheus(desc: Column, vcid: Column, unit: Column, value: Column) -> Column:
    """Two-line Prometheus exposition text of one reading."""
    return F.concat(F.lit("# "), desc, F.lit("\nvcId_"), vcid.cast("string"), F.lit('{unit="'),
                    F.coalesce(unit, F.lit("")), F.lit('"} '), value.cast("string"))


def render_csv(cols: Sequence[str]) -> Column:
    """One CSV record (Spark CSV quoting rules)."""
    return F.to_csv(F.struct(*cols))


def render_json(cols: Sequence[str]) -> Column:
    """One JSON object per row."""
    return F.to_json(F.struct(*cols))
