"""More queries over the driver's tables, each about one rule of a parser, a report or a setting, and their SQL.

Lines are rendered from `events` so that a case of the rule falls to each row by its id; SQL tells what the rule gives. Reports and settings
are read on the driver, as the operators do; their rows are few.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
import shutil
import tempfile
from datetime import UTC, datetime
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions.scoring import ScoringConfig, SourceThresholds
from quarrylog.operators import coverage, novelty, rules, summary, windows
from quarrylog.plans import policy, queries, sinks
from quarrylog.plans.queries import LOG, MICROS, query
from quarrylog.plans.report import Analysis, PipelineConfig
from quarrylog.sources import levels as L
from quarrylog.sources.reader import events_of, parse_lines, read_logs
from quarrylog.sources.reference import load_reference_windows, reference_table
from quarrylog.sources.storage import shared_folder



def _columns(name: str):
    """A column of the events that lines are rendered from; made when it is called, as columns need a session."""
    return lambda: F.col(name)


_id, _kind, _k, _user, _ts = map(_columns, ("id", "kind", "k", "user", "ts"))
_cat, _raw, _iso, log = queries._cat, queries._raw, queries._iso, queries.log


def _pick(by: Column, *options) -> Column:
    """Of the options that of each row's by (0, 1, ...)."""
    return F.element_at(F.array(*(o if isinstance(o, Column) else F.lit(o) for o in options)), (by % len(options) + 1).cast("int"))


def _message() -> Column:
    return _cat(_kind(), " k=", _k())


def _level() -> Column:
    return queries.level_of(_kind())


def _parsed(spark, sf_dir, line: Column, format: str, *more: Column) -> DataFrame:
    found = events_of(parse_lines(_raw(spark, sf_dir, line), format))
    return found.select("event_id", "level", "message", "source", F.unix_micros("timestamp").alias("micros"), *more)


def _field(name: str) -> Column:
    return F.col("fields")[name].alias(name)


def _n_fields() -> Column:
    return F.size("fields").cast("long").alias("n_fields")


# --- JSON records --------------------------------------------------------------------------------------------------------------------


@query(
    "parse_json_aliases",
    f"""WITH {LOG} SELECT event_id, CASE WHEN level = 'ERROR' AND event_id % 7 = 0 THEN 'CRITICAL' ELSE level END AS level, message, source, {MICROS} AS micros,
  0::BIGINT AS n_fields FROM l""",
)
def parse_json_aliases(spark, sf_dir):
    """Keys of each part in turn; of two the one that is looked for first counts. Names of levels in other spellings."""
    level = F.when((_kind() == "error") & (_id() % 7 == 0), _pick(_id(), "emergency", "Fatal", "CRIT")).when(_kind() == "error", _pick(_id(), "err", "Error")).when(_kind() == "purchase", _pick(_id(), "warning", " Warn ")).otherwise(_pick(_id(), "information", "informational", "info"))
    line = _cat(
        '{"MESSAGE":"another","', _pick(_id(), "message", "msg", "body"), '":"', _message(), '","severityText":"debug","', _pick(_id(), *L.LEVEL_KEYS[:-1]), '":"', level,
        '","logger":"another","', _pick(_id(), *L.SOURCE_KEYS[:-1]), '":"user-', _user(), '","', _pick(_id(), *L.TIME_KEYS), '":"', _iso(_ts()), '"}',
    )
    return _parsed(spark, sf_dir, line, "json", _n_fields())


@query("parse_json_nested", f"""WITH {LOG} SELECT event_id, level, message, source, {MICROS} AS micros, '{{"level": "' || lower(level) || '", "list": [1, {{"a": "b,c:d"}}]}}' AS log FROM l""")
def parse_json_nested(spark, sf_dir):
    line = _cat('{"@timestamp":"', _iso(_ts()), '","log":{"level":"', F.lower(_level()), '","list":[1,{"a" : "b,c:d"}]},"service":{"name":"user-', _user(), '"},"message":"', _message(), '"}')
    return _parsed(spark, sf_dir, line, "json", _field("log"))


@query(
    "parse_json_attributes",
    f"""WITH {LOG} SELECT event_id, message, source, '{{"attributes": [{{"key": "host", "value": {{"stringValue": "h"}}}}, {{"key": "service.name", "value": {{"stringValue": "' || source || '"}}}}]}}' AS resource, 1::BIGINT AS n_fields FROM l""",
)
def parse_json_attributes(spark, sf_dir):
    line = _cat('{"body":{"stringValue":"', _message(), '"},"resource":{"attributes":[{"key":"host","value":{"stringValue":"h"}},{"key":"service.name","value":{"stringValue":"user-', _user(), '"}}]}}')
    return _parsed(spark, sf_dir, line, "json", _field("resource"), _n_fields()).drop("level", "micros")


@query(
    "parse_json_bodies",
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN k WHEN 1 THEN 'true' WHEN 2 THEN '["a","' || k || '"]' WHEN 3 THEN k WHEN 4 THEN '{"a":"x","b":' || k || '}'
  WHEN 5 THEN '{"k":"' || k || '"}' ELSE 'None' END AS message FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""",
)
def parse_json_bodies(spark, sf_dir):
    body = _pick(
        _id(), _cat('{"intValue":"', _k(), '"}'), '{"boolValue":true}', _cat('{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":"', _k(), '"}]}}'), _k(),
        _cat('{"b":', _k(), ',"a":"x"}'), _cat('{"kvlistValue":{"values":[{"key":"k","value":{"intValue":"', _k(), '"}}]}}'), "null",
    )
    return _parsed(spark, sf_dir, _cat('{"body":', body, "}"), "json").select("event_id", "message")


@query(
    "parse_json_severities",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN n BETWEEN 1 AND 4 THEN 'TRACE' WHEN n BETWEEN 5 AND 8 THEN 'DEBUG' WHEN n BETWEEN 9 AND 12 THEN 'INFO' WHEN n BETWEEN 13 AND 16 THEN 'WARN'
    WHEN n BETWEEN 17 AND 20 THEN 'ERROR' WHEN n BETWEEN 21 AND 24 THEN 'CRITICAL' ELSE 'UNKNOWN' END
  ELSE CASE WHEN p <= 2 THEN 'CRITICAL' WHEN p = 3 THEN 'ERROR' WHEN p = 4 THEN 'WARN' WHEN p = 5 THEN 'NOTICE' WHEN p = 6 THEN 'INFO' WHEN p = 7 THEN 'DEBUG' ELSE 'UNKNOWN' END END AS level
FROM (SELECT event_id, event_id // 2 % 27 AS n, event_id // 2 % 10 AS p FROM events)""",
)
def parse_json_severities(spark, sf_dir):
    half = F.floor(_id() / 2)
    number, priority = _cat('{"severityNumber":', (half % 27).cast("string"), "}"), _cat('{"PRIORITY":"', (half % 10).cast("string"), '"}')
    return _parsed(spark, sf_dir, F.when(_id() % 2 == 0, number).otherwise(priority), "json").select("event_id", "level")


@query("parse_json_times", f"SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE {MICROS} END AS micros FROM events")
def parse_json_times(spark, sf_dir):
    """Offsets, nanoseconds, microseconds; a text that is no time gives way to the next key."""
    micros = F.unix_micros(queries.utc(_ts())).cast("string")
    ahead = _cat(F.date_format(_ts().cast("timestamp_ntz") + F.expr("INTERVAL '05:30' HOUR TO MINUTE"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "+05:30")
    line = _pick(
        _id(), _cat('{"time":"', ahead, '"}'), _cat('{"timeUnixNano":"', micros, '000"}'), _cat('{"timestamp":"no time","observed_timestamp":"', _iso(_ts()), '"}'),
        _cat('{"__REALTIME_TIMESTAMP":"', micros, '"}'), _cat('{"observedTimeUnixNano":', micros, "000}"), '{"message":"none"}',
    )
    return _parsed(spark, sf_dir, line, "json").select("event_id", "micros")


@query(
    "parse_json_failures",
    "SELECT event_id, event_id % 5 < 3 AS failed FROM events",
)
def parse_json_failures(spark, sf_dir):
    line = _pick(_id(), '{"level":', '["no","event"]', '{"level":"info"} x', '{"level":"info"}', _cat('{"n":', _k(), ', "text":"} \\"{"}'))
    return parse_lines(_raw(spark, sf_dir, line), "json").select("event_id", F.col("parse_error").isNotNull().alias("failed"))


@query("parse_json_fields", """SELECT event_id, k, '"' || k || '"' AS s, 'null' AS n, '[' || k || ', true]' AS a, '"q\\"\\\\"' AS q, 5::BIGINT AS n_fields FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)""")
def parse_json_fields(spark, sf_dir):
    line = _cat('{"level":"info","k":', _k(), ',"s":"', _k(), '","n":null,"a":[', _k(), ',true],"q":"q\\"\\\\"}')
    return _parsed(spark, sf_dir, line, "json", *map(_field, "ksnaq"), _n_fields()).drop("level", "message", "source", "micros")


# --- text lines --------------------------------------------------------------------------------------------------------------------


@query(
    "parse_text_times",
    f"""WITH {LOG} SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'UNKNOWN' ELSE level END AS level, {MICROS} AS micros, '"' || split_part(message, '=', 2) || '"' AS k FROM l""",
)
def parse_text_times(spark, sf_dir):
    """Times in two tokens and in brackets; the first token that names a level counts; time=... where no time leads."""
    apart = F.date_format(_ts().cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = _pick(_id(), _cat("[", apart, "+00:00] ", F.lower(_level()), ": DEBUG k=", _k()), _cat(apart, " severity=[", _level(), "], k=", _k()), _cat("no level, k=", _k(), " time='", _iso(_ts()), "'"))
    return _parsed(spark, sf_dir, line, "text", _field("k")).select("event_id", "level", "micros", "k")


@query(
    "parse_logfmt_fields",
    f"""WITH {LOG} SELECT event_id, level, source, {MICROS} AS micros, '"' || message || '"' AS msg, '"first"' AS a, '"say \\"hi\\""' AS q, 3::BIGINT AS n_fields FROM l""",
)
def parse_logfmt_fields(spark, sf_dir):
    line = _cat('ts="', _iso(_ts()), '" level="', F.lower(_level()), '" service=" user-', _user(), '" msg="', _message(), "\" a=first a=second q='say \"hi\"'")
    return _parsed(spark, sf_dir, line, "text", *map(_field, ("msg", "a", "q")), _n_fields()).drop("message")


@query(
    "text_levels_documents",
    """WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
words AS (SELECT list_transform(regexp_split_to_array(translate(line, '[]:', '   '), '\\s+'), lambda w: CASE WHEN regexp_matches(w, '^(?i)(level|severity)=') THEN upper(trim(split_part(w, '=', 2), '[],''"')) ELSE upper(w) END) AS w
  FROM lines WHERE regexp_matches(line, '[^\\s]')),
found AS (SELECT list_filter(w, lambda x: x IN ('TRACE', 'DEBUG', 'INFO', 'NOTICE', 'WARN', 'ERROR', 'CRITICAL', 'WARNING', 'ERR', 'FATAL', 'CRIT', 'ALERT', 'EMERG', 'EMERGENCY', 'INFORMATION', 'INFORMATIONAL'))[1] AS x FROM words)
SELECT CASE WHEN x IS NULL THEN 'UNKNOWN' WHEN x = 'WARNING' THEN 'WARN' WHEN x = 'ERR' THEN 'ERROR' WHEN x IN ('FATAL', 'CRIT', 'ALERT', 'EMERG', 'EMERGENCY') THEN 'CRITICAL'
  WHEN x IN ('INFORMATION', 'INFORMATIONAL') THEN 'INFO' ELSE x END AS level, count(*) AS lines FROM found GROUP BY 1""",
)
def text_levels_documents(spark, sf_dir):
    lines = queries.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw")).withColumn("provenance", F.lit("documents"))
    return parse_lines(lines, "text").groupBy("level").agg(F.count("*").alias("lines"))


# --- RFC 5424 --------------------------------------------------------------------------------------------------------------------


@query("rfc5424_header_bounds", "SELECT event_id, event_id // 4 % 3 = 2 AS failed, event_id % 4 AS part FROM events")
def rfc5424_header_bounds(spark, sf_dir):
    """Host, application, process and message ids one character below, at, and above their bounds."""
    bounds = (255, 48, 128, 32)
    part = lambda at: F.when(_id() % 4 == at, F.repeat(F.lit("x"), F.lit(bounds[at] - 1).cast("int") + (F.floor(_id() / 4) % 3).cast("int"))).otherwise(F.lit("-"))
    line = _cat("<14>1 - ", part(0), " ", part(1), " ", part(2), " ", part(3), " - text")
    return parse_lines(_raw(spark, sf_dir, line), "rfc5424").select("event_id", F.col("parse_error").isNotNull().alias("failed"), (F.col("event_id") % 4).alias("part"))


@query("rfc5424_header_values", "SELECT event_id, event_id % 9 > 2 AS failed FROM events")
def rfc5424_header_values(spark, sf_dir):
    """Priorities, versions and times at and beyond their bounds, and characters that no header may hold."""
    line = _pick(
        _id(), "<191>1 - - - - - -", "<0>999 2026-09-19T04:10:11.123456Z - - - - -", "<13>1 2026-09-19T04:10:11+05:30 h a p m - text",
        "<192>1 - - - - - -", "<13>1000 - - - - - -", "<13>1 2026-02-30T04:10:11Z - - - - -", "<13>1 2026-09-19T04:10:11 - - - - -", "<13>1 - hé - - - -", "<13>1 - h a",
    )
    return parse_lines(_raw(spark, sf_dir, line), "rfc5424").select("event_id", F.col("parse_error").isNotNull().alias("failed"))


_GOOD = ('[a@1 k="1"]', '[a k="1"][b j="2"]', '[a k="x\\"\\]\\\\"]', "[" + "n" * 32 + "]")
_BAD = ("[]", "[" + "n" * 33 + "]", '[a k="1]', '[a k="]"]', "[a k=1]", '[a b"c="1"]')
_DATA = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{json.dumps(x)}'" for k, x in enumerate(_GOOD)) + " END"


@query("rfc5424_structured_data", f"SELECT event_id, event_id % 10 >= {len(_GOOD)} AS failed, {_DATA} AS data, CASE WHEN event_id % 10 < {len(_GOOD)} THEN 'text ' || event_id END AS message FROM events")
def rfc5424_structured_data(spark, sf_dir):
    line = _cat("<14>1 - - - - - ", _pick(_id(), *_GOOD, *_BAD), " text ", _id().cast("string"))
    found = parse_lines(_raw(spark, sf_dir, line), "rfc5424")
    return found.select("event_id", F.col("parse_error").isNotNull().alias("failed"), F.col("fields")["syslog_structured_data"].alias("data"), "message")


@query(
    "rfc5424_messages",
    """SELECT event_id, CASE event_id % 3 WHEN 2 THEN '' ELSE 'text ' || event_id END AS message, CASE event_id % 3 WHEN 0 THEN 'true' END AS bom, CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'host' END AS source,
  (CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END + 7)::BIGINT AS n_fields FROM events""",
)
def rfc5424_messages(spark, sf_dir):
    rest = _pick(_id(), _cat(" ﻿text ", _id().cast("string")), _cat(" text ", _id().cast("string")), "")
    line = _cat("<14>1 - host ", _pick(_id(), "app", "-"), " - - -", rest)
    found = parse_lines(_raw(spark, sf_dir, line), "rfc5424")
    return found.select("event_id", "message", F.col("fields")["syslog_utf8_bom"].alias("bom"), "source", _n_fields())


# --- events --------------------------------------------------------------------------------------------------------------------------


@query(
    "time_windows_missing_times",
    f"""WITH {LOG} SELECT strftime(time_bucket(INTERVAL '60 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S+00:00') AS start, count(*) AS events, count(*) FILTER (level = 'ERROR') AS error_events,
  sum(count(*)) OVER ()::BIGINT AS timestamped FROM l WHERE event_id % 3 <> 0 GROUP BY 1""",
)
def time_windows_missing_times(spark, sf_dir):
    events = log(spark, sf_dir).withColumn("timestamp", F.when(F.col("ord") % 3 != 0, F.col("timestamp")))
    found = windows.build_time_windows(events, window_minutes=60).drop("levels", "end")
    return found.join(found.agg(F.sum("events").alias("timestamped")))


@query(
    "repeated_messages_blank",
    f"""WITH {LOG}, c AS (SELECT source, level, CASE WHEN event_id % 2 = 0 THEN '' ELSE split_part(message, ' ', 1) END AS message FROM l), g AS (SELECT source, level, message, count(*) AS n, sum(count(*)) OVER (PARTITION BY source, level) AS total FROM c GROUP BY source, level, message)
SELECT 'Repeated message [' || source || ']: ' || message AS message, n AS count, {queries._score("n", "3", "total")} AS score FROM g WHERE message <> '' AND n >= 3""",
)
def repeated_messages_blank(spark, sf_dir):
    """Blank messages count in their scope's total and make no finding."""
    blank = F.when(F.col("ord") % 2 == 0, "  \t").otherwise(F.split("message", " ")[0])
    found = rules.repeated_messages(rules.message_counts(log(spark, sf_dir).withColumn("message", blank)), repeat_threshold=3)
    return found.select("message", "count", "score")


@query(
    "shown_contexts",
    """SELECT DISTINCT event_type AS kind, k, CASE WHEN length(x) <= 24 THEN x ELSE left(x, 21) || '...' END AS shown
FROM (SELECT event_type, k, event_type || '\\n\\t\\x07\\u200b\\u2028' || repeat('y', k) AS x FROM (SELECT event_type, json_extract_string(props, '$.k')::INT % 12 AS k FROM events))""",
)
def shown_contexts(spark, sf_dir):
    """Control and format characters made visible, then cut to the longest context."""
    k = (F.col("fields")["k"].cast("int") % 12).alias("k")
    given = F.concat("kind", F.lit("\n\t\x07​ "), F.expr("repeat('y', k)"))
    return log(spark, sf_dir).select(F.split("message", " ")[0].alias("kind"), k).distinct().select("kind", "k", rules.shown(given, ScoringConfig(max_finding_context=24)).alias("shown"))


@query(
    "field_names",
    """SELECT 'a b' AS field, count(*) AS present, 0::BIGINT AS nulls, 1.0::DOUBLE AS coverage FROM events UNION ALL
SELECT '<empty>', count(*), 0, count(*) / (SELECT count(*) FROM events) FROM events WHERE event_id % 2 = 0 UNION ALL
SELECT 'n', count(*), count(*) FILTER (event_id % 4 = 0), 1.0 FROM events""",
)
def field_names(spark, sf_dir):
    """Spellings of a name are one field, null only if all are; a name without characters is <empty>."""
    even = F.col("ord") % 2 == 0
    third = F.when(F.col("ord") % 4 == 0, "null").otherwise("1")
    spelled = F.map_from_arrays(
        F.filter(F.array(F.lit(" a \tb"), F.lit("a b"), F.lit("n"), F.lit("ｎ"), F.when(even, " \n")), lambda x: x.isNotNull()),
        F.when(even, F.array(F.lit("1"), F.lit("null"), F.lit("null"), third, F.lit("true"))).otherwise(F.array(F.lit("1"), F.lit("null"), F.lit("null"), third)),
    )
    return coverage.field_coverage(log(spark, sf_dir).withColumn("fields", spelled)).select("field", "present", "nulls", "coverage")


def _placed(table: DataFrame) -> DataFrame:
    """A small table's rows with their places, from 1, in its order."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


@query("order_sources", f"WITH {LOG} SELECT source, row_number() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT source FROM l)")
def order_sources(spark, sf_dir):
    return _placed(summary.source_health(log(spark, sf_dir)).select("source"))


@query("order_windows", f"WITH {LOG} SELECT strftime(s, '%Y-%m-%dT%H:%M:%S+00:00') AS start, row_number() OVER (ORDER BY s) AS place FROM (SELECT DISTINCT time_bucket(INTERVAL '1440 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS s FROM l)")
def order_windows(spark, sf_dir):
    return _placed(windows.build_time_windows(log(spark, sf_dir), window_minutes=1440).select("start"))


@query(
    "order_findings",
    f"WITH {LOG}, {queries._elevated('10')}, {queries._repeated(2)} SELECT message, row_number() OVER (ORDER BY r, message) AS place FROM (SELECT 1 AS r, message FROM d1 UNION ALL SELECT 2, message FROM d2)",
)
def order_findings(spark, sf_dir):
    """Rules in their order, then sources and messages; sources here are of one length, so that their texts sort as they do."""
    found = rules.all_findings(log(spark, sf_dir).where("source is not null"), error_threshold=10, repeat_threshold=2, burst_threshold=10**6)
    found = found.withColumn("_source", F.col("message")).withColumn("_level", F.lit("")).withColumn("_key", F.lit(""))
    return _placed(rules.ordered(found).select("message"))


@query(
    "histogram_maps",
    f"WITH {LOG} SELECT level AS key, count(*) AS n, row_number() OVER (ORDER BY level) - 1 AS place FROM l GROUP BY level",
)
def histogram_maps(spark, sf_dir):
    """The maps of a summary hold their keys in order."""
    return summary.summarize(log(spark, sf_dir)).select(F.posexplode(F.map_entries("levels")).alias("place", "e")).select(F.col("e.key").alias("key"), F.col("e.value").alias("n"), F.col("place").cast("long").alias("place"))


# --- files, reports, settings ------------------------------------------------------------------------------------------------------------


@query("scan_text_files", "SELECT f.file, events.event_type AS level, count(*) AS lines FROM events, (VALUES ('plain'), ('gzip'), ('odd')) f(file) GROUP BY ALL")
def scan_text_files(spark, sf_dir):
    """The log as text, as gzip, and as gzip with an odd suffix, with blank lines between the lines."""
    lines = queries.table(spark, sf_dir, "events").select(F.concat(F.lit("level="), F.when(F.col("event_type") == "error", "error").otherwise("info"), F.lit(" kind="), F.col("event_type"), F.lit("\n  \n")).alias("value"))
    folder = shared_folder(spark, "scan")
    lines.write.text(f"{folder}/plain")
    lines.write.option("compression", "gzip").text(f"{folder}/gzip")
    import pyarrow.fs

    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(f"{at}/odd")
    with fs.open_output_stream(f"{at}/odd/LOG.GZ") as file:
        packed = gzip.GzipFile(fileobj=file, mode="wb")
        for r in lines.toLocalIterator():
            packed.write((r["value"] + "\r\n").encode())
        packed.close()
    found = None
    for name, path in (("plain", f"{folder}/plain"), ("gzip", f"{folder}/gzip"), ("odd", f"{folder}/odd/LOG.GZ")):
        rows = read_logs(spark, path, "text").select(F.lit(name).alias("file"), F.get_json_object(F.concat(F.lit('{"x":'), F.col("fields")["kind"], F.lit("}")), "$.x").alias("level"))
        found = rows if found is None else found.union(rows)
    return found.groupBy("file", "level").agg(F.count("*").alias("lines"))


def _analysis(spark, sf_dir) -> Analysis:
    line = _cat('{"time":"', _iso(_ts()), '","severity":"', _level(), '","service":"user-', _user(), '","msg":"', _message(), '"}')
    lines = _raw(spark, sf_dir, F.when(_id() % 50 == 0, "{broken").otherwise(line)).withColumn("ord", F.col("event_id"))
    return Analysis(lines, PipelineConfig(format="json", error_threshold=10, window_minutes=1440, burst_threshold=10**6, repeat_threshold=10**6), source_name="events.log")


def _report(spark, sf_dir) -> dict:
    analysis = _analysis(spark, sf_dir)
    try:
        return analysis.report(max_parse_errors=7)
    finally:
        analysis.close()


_REPORT = f"""WITH {LOG}, g AS (SELECT * FROM l WHERE event_id % 50 <> 0),
  w AS (SELECT strftime(time_bucket(INTERVAL '1440 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S+00:00') AS start, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e FROM g GROUP BY 1)"""


@query(
    "report_json",
    f"""{_REPORT} SELECT s.sink, (SELECT count(*) FROM l) AS input_events, (SELECT count(*) FROM g) AS matched_events, (SELECT count(*) FROM l WHERE event_id % 50 = 0) AS parse_errors, (SELECT count(DISTINCT source) FROM g) AS sources,
  (SELECT count(*) FROM w) AS windows, (SELECT count(*) FROM (SELECT source FROM g GROUP BY source HAVING count(*) FILTER (level = 'ERROR') >= 10)) AS findings FROM (VALUES ('document'), ('line')) s(sink)""",
)
def report_json(spark, sf_dir):
    report = _report(spark, sf_dir)
    rows = []
    for sink, text in (("document", sinks.report_to_json(report)), ("line", sinks.report_to_json_line(report))):
        if sink == "line" and "\n" in text:
            raise ValueError("a report line holds one line")
        r = json.loads(text)
        rows.append((sink, r["input_events"], r["matched_events"], r["parse_errors"], len(r["sources"]), len(r["time_baseline"]["windows"]), len(r["findings"])))
    return spark.createDataFrame(rows, "sink string, input_events long, matched_events long, parse_errors long, sources long, windows long, findings long")


@query(
    "report_csv",
    f"""{_REPORT}, h AS (SELECT source, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e FROM g GROUP BY source)
SELECT 'level' AS record_type, level AS name, count(*)::VARCHAR AS value, '' AS score FROM g GROUP BY level UNION ALL SELECT 'source', source, n::VARCHAR, '' FROM h UNION ALL SELECT 'source_health', source, n::VARCHAR, e::VARCHAR FROM h
UNION ALL SELECT 'window', start, n::VARCHAR, e::VARCHAR FROM w UNION ALL SELECT 'baseline', 'window_minutes', '1440', '' UNION ALL SELECT 'summary', 'max_parse_errors', '7', ''""",
)
def report_csv(spark, sf_dir):
    rows = list(csv.reader(io.StringIO(sinks.report_to_csv(_report(spark, sf_dir)))))
    kept = [r for r in rows[1:] if r[0] in ("level", "source", "source_health", "window") or r[:2] in (["baseline", "window_minutes"], ["summary", "max_parse_errors"])]
    return spark.createDataFrame([(r[0], r[1], r[2], r[4]) for r in kept], "record_type string, name string, value string, score string")


@query(
    "report_text",
    f"""{_REPORT} SELECT 'Input: ' || (SELECT count(*) FROM l) || ' | Matched: ' || count(*) || ' | Parse errors: ' || (SELECT count(*) FROM l WHERE event_id % 50 = 0) AS line FROM g
UNION ALL SELECT lpad(level, 8, ' ') || ': ' || count(*) FROM g GROUP BY level UNION ALL SELECT 'Time windows: ' || (SELECT count(*) FROM w) || ' x 1440m | Timestamped: ' || count(*) FROM g""",
)
def report_text(spark, sf_dir):
    lines = [x for x in sinks.report_to_text(_report(spark, sf_dir)).split("\n") if x.startswith(("Input", "Time windows", "   "))]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query(
    "csv_cells",
    """SELECT x AS given, CASE WHEN ltrim(x)[1] IN ('=', '+', '-', '@') THEN '''' || x ELSE x END AS cell FROM (SELECT DISTINCT p.p || event_type AS x FROM events, (VALUES ('='), ('+'), ('-'), ('@'), (' ='), (''), ('a-')) p(p))""",
)
def csv_cells(spark, sf_dir):
    kinds = [r[0] for r in queries.table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    given = [p + k for p in ("=", "+", "-", "@", " =", "", "a-") for k in kinds]
    return spark.createDataFrame([(x, sinks.csv_cell(x)) for x in given], "given string, cell string")


@query("csv_visible", "SELECT * FROM (VALUES (10, '\\n'), (13, '\\r'), (9, '\\t'), (7, '\\x07'), (127, '\\x7f'), (8203, '\\u200b'), (8232, '\\u2028'), (65, 'A'), (233, 'é')) v(code, cell)")
def csv_visible(spark, sf_dir):
    return spark.createDataFrame([(c, sinks.csv_cell("x" + chr(c))[1:]) for c in (10, 13, 9, 7, 127, 8203, 8232, 65, 233)], "code int, cell string")


@query(
    "corpus_file",
    f"""WITH {LOG}, o AS (SELECT source, level, message, count(*) AS n FROM l WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT source, level, message, n AS count, '2024-01-16T00:00:00+00:00' AS first_seen FROM o""",
)
def corpus_file(spark, sf_dir):
    """A corpus learned, saved as a file and read again."""
    old, _ = queries._halves(spark, sf_dir)
    corpus = novelty.KnownCorpus()
    corpus.learn(old, observed_at=datetime(2024, 1, 16, tzinfo=UTC))
    with tempfile.TemporaryDirectory() as folder:  # the driver's file, as the command line's is
        corpus.save(f"{folder}/known.json")
        return novelty.KnownCorpus.load(f"{folder}/known.json").table(spark)


@query(
    "baseline_reference_file",
    f"""{_REPORT} SELECT start, n AS events, e AS error_events, 1440::BIGINT AS minutes FROM w""",
)
def baseline_reference_file(spark, sf_dir):
    """A saved report as the reference of a comparison."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "report.json"
        path.write_text(sinks.report_to_json(_report(spark, sf_dir)), encoding="utf-8")
        rows, minutes = load_reference_windows(path)
    return reference_table(spark, rows).drop("position").withColumn("minutes", F.lit(minutes).cast("long"))


_POLICIES = """
[policy.default]
error_threshold = 3
[policy.strict]
repeat_threshold = 2
[policy.strict.scoring]
medium_cutoff = 40
[policy.strict.sources." User-1 "]
burst_threshold = 9
"""


@query(
    "policy_settings",
    """SELECT * FROM (VALUES ('default', 3, 5, 5, 60, 60, NULL, NULL), ('strict', 5, 2, 5, 60, 40, 'User-1', 9))
v(policy, error_threshold, repeat_threshold, burst_threshold, burst_window_seconds, medium_cutoff, source, source_burst)""",
)
def policy_settings(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "policies.TOML"
        path.write_text(_POLICIES, encoding="utf-8")
        found = policy.load_policies(path)
    rows = []
    for name in ("default", "strict"):
        p = policy.resolve_policy(found, name)
        own = next(iter(p.sources.items()), (None, None))
        rows.append((p.name, p.error_threshold, p.repeat_threshold, p.burst_threshold, p.burst_window_seconds, p.scoring.medium_cutoff, own[0], own[1] and own[1].burst_threshold))
    return spark.createDataFrame(rows, "policy string, error_threshold int, repeat_threshold int, burst_threshold int, burst_window_seconds int, medium_cutoff int, source string, source_burst int")


def _accepted(check) -> bool:
    try:
        check()
    except (ValueError, SystemExit):
        return False
    return True


def _policy_file(content: str, name: str = "p.json", wanted: str | None = None):
    def check():
        with tempfile.TemporaryDirectory() as folder:
            (Path(folder) / name).write_text(content, encoding="utf-8")
            policy.resolve_policy(policy.load_policies(Path(folder) / name), wanted)

    return check


def _json_file(load, content: str):
    def check():
        with tempfile.TemporaryDirectory() as folder:
            (Path(folder) / "f.json").write_text(content, encoding="utf-8")
            load(Path(folder) / "f.json")

    return check


def _options(*options: str):
    def check():
        import contextlib

        from quarrylog.cli import build_parser

        with contextlib.redirect_stderr(io.StringIO()):
            build_parser().parse_args(["analyze", "x", *options])

    return check


def _rule(name: str, least: int) -> list[tuple[str, bool, object]]:
    return [(f"{name} {v!r}", ok, lambda v=v: rules.check_thresholds(**{name: v})) for v, ok in ((least, True), (least - 1, False), (True, False), (2.0, False))]


#: What a setting or a file is, and if it is accepted.
_CASES = [
    *_rule("error_threshold", 1), *_rule("repeat_threshold", 2), *_rule("burst_threshold", 2), *_rule("burst_window_seconds", 1),
    *((f"window_minutes {v!r}", ok, lambda v=v: windows.check_window_minutes(v)) for v, ok in ((1, True), (1440, True), (0, False), (1441, False), (5.0, False), (True, False))),
    *((f"diff threshold {v!r}", ok, lambda v=v: windows.check_diff_threshold(v)) for v, ok in ((0, True), (1, True), (0.2, True), (1.1, False), (-0.1, False), (float("nan"), False), ("0.2", False))),
    *((f"medium {m} high {h}", ok, lambda m=m, h=h: ScoringConfig(medium_cutoff=m, high_cutoff=h)) for m, h, ok in ((60, 80, True), (80, 80, False), (0, 80, False), (60, 101, False))),
    *((f"base_points {v!r}", ok, lambda v=v: ScoringConfig(base_points=v)) for v, ok in ((0, True), (-1, False), (1.5, False))),
    *((f"max_finding_context {v!r}", ok, lambda v=v: ScoringConfig(max_finding_context=v)) for v, ok in ((1, True), (0, False))),
    *((f"source repeat_threshold {v!r}", ok, lambda v=v: SourceThresholds(repeat_threshold=v)) for v, ok in ((2, True), (None, True), (1, False))),
    *((f"format {v}", ok, lambda v=v: parse_format(v)) for v, ok in (("auto", True), ("rfc5424", True), ("xml", False))),
    ("policy default", True, _policy_file('{"policy":{"default":{},"b":{}}}')),
    ("policy the only one", True, _policy_file('{"policy":{"b":{}}}')),
    ("policy of several", False, _policy_file('{"policy":{"a":{},"b":{}}}')),
    ("policy by name", True, _policy_file('{"policy":{"a":{},"b":{}}}', wanted="b")),
    ("policy unknown", False, _policy_file('{"policy":{"a":{}}}', wanted="c")),
    ("policy suffix", False, _policy_file('{"policy":{"a":{}}}', name="p.yaml")),
    ("policy broken", False, _policy_file("{")),
    ("policy without tables", False, _policy_file('{"policy":{}}')),
    ("policy other setting", False, _policy_file('{"policy":{"a":{"errors":1}}}')),
    ("policy low threshold", False, _policy_file('{"policy":{"a":{"repeat_threshold":1}}}')),
    ("policy true threshold", False, _policy_file('{"policy":{"a":{"error_threshold":true}}}')),
    ("policy cutoffs", False, _policy_file('{"policy":{"a":{"scoring":{"medium_cutoff":90}}}}')),
    ("policy blank source", False, _policy_file('{"policy":{"a":{"sources":{" ":{}}}}}')),
    ("policy equal sources", False, _policy_file('{"policy":{"a":{"sources":{"x":{}," x ":{}}}}}')),
    ("policy source", True, _policy_file('{"policy":{"a":{"sources":{"x":{"burst_threshold":2}}}}}')),
    ("corpus", True, _json_file(novelty.KnownCorpus.load, '{"version":1,"messages":[{"source":null,"level":"INFO","message":"m","count":2}]}')),
    ("corpus empty", True, _json_file(novelty.KnownCorpus.load, "{}")),
    ("corpus version", False, _json_file(novelty.KnownCorpus.load, '{"version":2}')),
    ("corpus list", False, _json_file(novelty.KnownCorpus.load, "[]")),
    ("corpus messages", False, _json_file(novelty.KnownCorpus.load, '{"messages":{}}')),
    ("corpus count", False, _json_file(novelty.KnownCorpus.load, '{"messages":[{"level":"INFO","message":"m","count":-1}]}')),
    ("corpus level", False, _json_file(novelty.KnownCorpus.load, '{"messages":[{"message":"m"}]}')),
    ("reference", True, _json_file(load_reference_windows, '{"windows":[{"start":"a","events":"3","error_events":0}]}')),
    ("reference report", True, _json_file(load_reference_windows, '{"time_baseline":{"windows":[],"window_minutes":5}}')),
    ("reference without windows", False, _json_file(load_reference_windows, '{"events":3}')),
    ("reference negative", False, _json_file(load_reference_windows, '{"windows":[{"start":"a","events":-3,"error_events":0}]}')),
    ("reference true", False, _json_file(load_reference_windows, '{"windows":[{"start":"a","events":true,"error_events":0}]}')),
    *((f"option {' '.join(o)}", ok, _options(*o)) for o, ok in (
        (("--error-threshold", "1"), True), (("--error-threshold", "0"), False), (("--repeat-threshold", "1"), False), (("--window-minutes", "1441"), False), (("--window-minutes", "x"), False),
        (("--baseline-diff-threshold", "nan"), False), (("--watch-interval", "0"), False), (("--watch-interval", "0.1"), True), (("--json", "--csv"), False), (("--fail-on-severity", "none"), False), (("--fail-on-severity", "high"), True),
    )),
]


def parse_format(name: str) -> None:
    from quarrylog.sources.reader import check_format

    check_format(name)


_VALUES = ", ".join("('{}', {})".format(name.replace("'", "''"), str(ok).lower()) for name, ok, _ in _CASES)


@query("settings", f"SELECT * FROM (VALUES {_VALUES}) v(setting, accepted)")
def settings(spark, sf_dir):
    """Which settings and files are accepted."""
    return spark.createDataFrame([(name, _accepted(check)) for name, _, check in _CASES], "setting string, accepted boolean")


@query(
    "concentrated_arguments",
    "SELECT min_errors, min_error_rate::DOUBLE AS min_error_rate, accepted FROM (VALUES (1, 0.0, true), (3, 1.0, true), (0, 0.5, false), (3, 1.5, false), (3, -0.5, false)) v(min_errors, min_error_rate, accepted)",
)
def concentrated_arguments(spark, sf_dir):
    events = log(spark, sf_dir)
    given = [(1, 0.0), (3, 1.0), (0, 0.5), (3, 1.5), (3, -0.5)]
    return spark.createDataFrame([(n, r, _accepted(lambda n=n, r=r: summary.concentrated_error_sources(events, min_errors=n, min_error_rate=r))) for n, r in given], "min_errors int, min_error_rate double, accepted boolean")


@query(
    "watch_stream",
    f"""WITH {LOG}, a AS (SELECT source, count(*) FILTER (level = 'ERROR') AS e FROM l WHERE event_id % 2 = 0 GROUP BY source), b AS (SELECT source, count(*) FILTER (level = 'ERROR') AS e FROM l GROUP BY source)
SELECT 'Elevated error-level event count [' || source || ']' AS message, e AS count FROM a WHERE e >= 8 UNION ALL SELECT 'Elevated error-level event count [' || b.source || ']', b.e FROM b JOIN a USING (source) WHERE b.e >= 8 AND a.e < 8
UNION ALL SELECT 'Elevated error-level event count [' || source || ']', e FROM b WHERE e >= 8 AND source NOT IN (SELECT source FROM a)""",
)
def watch_stream(spark, sf_dir):
    """A file that grows while it is watched: what the first half of the lines shows is told once, then what the second half adds."""
    from quarrylog.streaming.tail import Watch, lines_of

    def joined(batches):
        for b in batches:
            lines = "".join(line + "\n" for line in b.column(0).to_pylist() if line is not None)
            yield pa.RecordBatch.from_arrays([pa.array([lines.encode()], pa.binary())], ["lines"])

    rendered = _raw(spark, sf_dir, _cat("level=", F.lower(_level()), " service=user-", _user(), " ", _message()))
    told: list[dict] = []
    with tempfile.TemporaryDirectory() as folder:  # a log file of the driver's
        path, grown = Path(folder) / "app.log", Path(folder) / "grown"
        path.write_text("")
        watch = Watch(spark, PipelineConfig(format="text", error_threshold=8, repeat_threshold=10**6, burst_threshold=10**6), shared_folder(spark, "watch"), lambda _, fresh: told.extend(fresh))
        stream = lines_of(spark, str(path)).writeStream.foreachBatch(watch.batch).option("checkpointLocation", f"{watch.state}/checkpoint").start()
        try:
            for half in (0, 1):
                # the file grows by a half at once, as a scan takes what is there when it begins
                shutil.copyfile(path, grown)
                with grown.open("ab") as file:
                    for (lines,) in rendered.where(F.col("event_id") % 2 == half).select("raw").mapInArrow(joined, "lines binary").toLocalIterator():
                        file.write(lines)
                    file.write(b"a line without its end")
                grown.replace(path)
                stream.processAllAvailable()
                with path.open("r+") as file:
                    file.truncate(path.stat().st_size - len("a line without its end"))
        finally:
            stream.stop()
    return spark.createDataFrame([(f["message"], f["count"]) for f in told], "message string, count long")
