"""Queries over the driver's tables, and their SQL.

The log is `events`: source user-<user_id>, level from event_type, message `<event_type> k=<k>`, fields from props. Parsers are checked
by round trips: lines are rendered from columns, and the parsed rows must hold the columns again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions import text
from quarrylog.functions.scoring import ScoringConfig, SourceThresholds
from quarrylog.operators import coverage, filters, novelty, rules, summary, windows
from quarrylog.sources.reader import events_of, parse_lines, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# --- the log ---------------------------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level_of(kind: Column) -> Column:
    return F.when(kind == "error", "ERROR").when(kind == "purchase", "WARN").otherwise("INFO")


def utc(ts: Column) -> Column:
    """A timestamp without zone as the instant of that time in UTC, whatever the session's zone is."""
    return F.to_timestamp(F.concat(ts.cast("timestamp_ntz").cast("string"), F.lit("Z")))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.concat(F.col("event_type"), F.lit(" k="), k).alias("message"), level_of(F.col("event_type")).alias("level"), utc(F.col("ts")).alias("timestamp"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"), F.create_map(F.lit("k"), k).alias("fields"), F.col("event_id").alias("ord"),
    )


LOG = """l AS (SELECT event_id, event_type || ' k=' || json_extract_string(props, '$.k') AS message,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS level, ts, 'user-' || user_id AS source FROM events)"""
MICROS = "epoch_us(ts)"

# --- summaries ---------------------------------------------------------------------------------------------------------------


@query("level_histogram", f"WITH {LOG} SELECT level, count(*) AS events FROM l GROUP BY level")
def level_histogram(spark, sf_dir):
    return summary.level_histogram(log(spark, sf_dir))


@query("source_histogram", f"WITH {LOG} SELECT source, count(*) AS events FROM l GROUP BY source")
def source_histogram(spark, sf_dir):
    return summary.source_histogram(log(spark, sf_dir))


@query("summary_total", f"WITH {LOG} SELECT count(*) AS events, count(DISTINCT level) AS levels, count(DISTINCT source) AS sources FROM l")
def summary_total(spark, sf_dir):
    return summary.summarize(log(spark, sf_dir)).select("events", F.size("levels").cast("long").alias("levels"), F.size("sources").cast("long").alias("sources"))


_HEALTH = f"""WITH {LOG}, h AS (SELECT source, count(*) AS events, count(*) FILTER (level = 'ERROR') AS error_events, count(*) FILTER (level = 'ERROR') / count(*) AS error_rate,
  count(*) FILTER (level = 'INFO') AS info, count(*) FILTER (level = 'WARN') AS warn FROM l GROUP BY source) SELECT * FROM h"""


def _flat_health(df: DataFrame) -> DataFrame:
    count = lambda level: F.coalesce(F.try_element_at("levels", F.lit(level)), F.lit(0)).cast("long")
    return df.select("source", "events", "error_events", "error_rate", count("INFO").alias("info"), count("WARN").alias("warn"))


@query("source_health", _HEALTH)
def source_health(spark, sf_dir):
    return _flat_health(summary.source_health(log(spark, sf_dir)))


@query("concentrated_error_sources", _HEALTH + " WHERE error_events >= 15 AND error_rate >= 0.2")
def concentrated(spark, sf_dir):
    return _flat_health(summary.concentrated_error_sources(log(spark, sf_dir), min_errors=15, min_error_rate=0.2))


@query("summarize_sources_rounded", f"WITH {LOG} SELECT source, count(*) AS events, count(*) FILTER (level = 'ERROR') AS error_events, round_even(count(*) FILTER (level = 'ERROR') / count(*), 4) AS error_rate FROM l GROUP BY source")
def summarize_sources_rounded(spark, sf_dir):
    return summary.summarize_sources(log(spark, sf_dir)).select("source", "events", "error_events", "error_rate")


@query(
    "filter_level_source_contains",
    f"WITH {LOG} SELECT source, level, message, {MICROS} AS micros FROM l WHERE level IN ('ERROR', 'WARN') AND contains(lower(message), 'k=1') AND source IN ('user-1', 'user-2', 'user-3', 'user-4', 'user-5', 'user-6', 'user-7', 'user-8')",
)
def filter_level_source_contains(spark, sf_dir):
    found = filters.filter_events(log(spark, sf_dir), levels=["error", " Warn "], contains="K=1", sources=[f"USER-{k}" for k in range(1, 9)])
    return found.select("source", "level", "message", F.unix_micros("timestamp").alias("micros"))


# --- windows ---------------------------------------------------------------------------------------------------------------------

_WINDOW = f"""WITH {LOG}, w AS (SELECT time_bucket(INTERVAL '{{n}} minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS s, level FROM l),
  g AS (SELECT s, count(*) AS events, count(*) FILTER (level = 'ERROR') AS error_events FROM w GROUP BY s)
SELECT strftime(s, '%Y-%m-%dT%H:%M:%S+00:00') AS start, strftime(s + INTERVAL '{{n}} minutes', '%Y-%m-%dT%H:%M:%S+00:00') AS "end", events, error_events FROM g"""

for _n in (5, 7, 60, 1440):

    @query(f"time_windows_{_n}m", _WINDOW.format(n=_n))
    def time_windows(spark, sf_dir, n=_n):
        return windows.build_time_windows(log(spark, sf_dir), window_minutes=n).drop("levels")


@query("time_window_levels", f"WITH {LOG} SELECT epoch(time_bucket(INTERVAL '60 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01'))::BIGINT AS start, level, count(*) AS n FROM l GROUP BY 1, 2")
def time_window_levels(spark, sf_dir):
    return windows.window_level_counts(log(spark, sf_dir), window_minutes=60)


# --- rules -----------------------------------------------------------------------------------------------------------------------

_SEVERITY = "CASE WHEN score >= 80 THEN 'high' WHEN score >= 60 THEN 'medium' ELSE 'low' END AS severity"


def _score(n: str, limit: str, total: str) -> str:
    """The score in SQL."""
    return f"least(100, 50 + least(25, round_even(25 * greatest(0, {n} - {limit}) / {limit}, 0)) + least(25, round_even(25 * {n} / {total}, 0)))::INTEGER"


def _elevated(limit: str, name: str = "d1") -> str:
    return f"""{name} AS (SELECT 'elevated-errors' AS rule, 'Elevated error-level event count [' || source || ']' AS message, errors AS count, {_score("errors", limit, "total")} AS score
  FROM (SELECT source, count(*) AS total, count(*) FILTER (level = 'ERROR') AS errors FROM l GROUP BY source) WHERE errors >= {limit})"""


def _repeated(limit: int, name: str = "d2") -> str:
    return f"""{name} AS (SELECT 'repeated-message' AS rule, 'Repeated message [' || source || ']: ' || message AS message, n AS count, {_score("n", str(limit), "total")} AS score
  FROM (SELECT source, level, message, count(*) AS n, sum(count(*)) OVER (PARTITION BY source, level) AS total FROM l GROUP BY source, level, message) WHERE n >= {limit})"""


def _burst(limit: int, seconds: int, source: str = "source", name: str = "d3") -> str:
    return f"""{name}_t AS (SELECT {source} AS source, level, {MICROS} AS t FROM l JOIN events USING (event_id, ts)),
  {name}_w AS (SELECT source, t, count(*) OVER w AS n, t - min(t) OVER w AS span FROM {name}_t WHERE level = 'ERROR' WINDOW w AS (PARTITION BY source ORDER BY t RANGE BETWEEN {seconds * 1_000_000} PRECEDING AND CURRENT ROW)),
  {name}_b AS (SELECT source, n, span FROM {name}_w QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, span) = 1),
  {name}_s AS (SELECT source, count(*) AS total FROM {name}_t GROUP BY source),
  {name} AS (SELECT 'error-burst' AS rule, 'Error burst [' || b.source || ']: ' || n || ' events in ' || printf('%g', span / 1000000) || 's (configured window {seconds}s)' AS message,
    b.source, n AS count, span, {_score("n", str(limit), "total")} AS score FROM {name}_b b JOIN {name}_s s ON b.source = s.source WHERE n >= {limit})"""


def _novel() -> str:
    """Messages of the second half of January against those of the first half."""
    return f"""old AS (SELECT DISTINCT source, level, message FROM l WHERE ts < TIMESTAMP '2024-01-16'),
  g AS (SELECT source, level, message, count(*) AS n, sum(count(*)) OVER (PARTITION BY source, level) AS total FROM l WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY source, level, message),
  d4 AS (SELECT 'novel-message' AS rule, 'Novel message [' || source || ']: ' || message AS message, n AS count, {_score("n", "1", "total")} AS score FROM g
    WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.source IS NOT DISTINCT FROM g.source AND old.level = g.level AND old.message = g.message))"""


@query("elevated_errors", f"WITH {LOG}, {_elevated('10')} SELECT *, {_SEVERITY} FROM d1")
def elevated_errors(spark, sf_dir):
    return rules.ordered(rules.elevated_errors(rules.message_counts(log(spark, sf_dir)), error_threshold=10))


@query("repeated_messages", f"WITH {LOG}, {_repeated(2)} SELECT *, {_SEVERITY} FROM d2")
def repeated_messages(spark, sf_dir):
    return rules.ordered(rules.repeated_messages(rules.message_counts(log(spark, sf_dir)), repeat_threshold=2))


def _burst_rows(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    counts, moments = rules.message_counts(events), rules.error_moments(events)
    spans = rules.bursts(moments, burst_window_seconds=seconds).select("source", "span")
    found = rules.error_bursts(moments, counts, burst_threshold=limit, burst_window_seconds=seconds).withColumnRenamed("_source", "source")
    return found.join(spans, "source").select("rule", "message", "source", "count", "span", "score", "severity")


@query("error_burst", f"WITH {LOG}, {_burst(3, 86400)} SELECT *, {_SEVERITY} FROM d3")
def error_burst(spark, sf_dir):
    return _burst_rows(log(spark, sf_dir), 3, 86400)


@query("error_burst_by_type", f"WITH {LOG}, {_burst(3, 3600, 'event_type')} SELECT *, {_SEVERITY} FROM d3")
def error_burst_by_type(spark, sf_dir):
    return _burst_rows(log(spark, sf_dir).withColumn("source", F.split("message", " ")[0]), 3, 3600)


@query("source_overrides", f"WITH {LOG}, {_elevated("CASE source WHEN 'user-1' THEN 3 WHEN 'user-2' THEN 1000 ELSE 12 END")} SELECT *, {_SEVERITY} FROM d1")
def source_overrides(spark, sf_dir):
    own = {"user-1": SourceThresholds(error_threshold=3), "user-2": SourceThresholds(error_threshold=1000)}
    return rules.ordered(rules.elevated_errors(rules.message_counts(log(spark, sf_dir)), error_threshold=12, overrides=own))


@query("scoring_config", f"WITH {LOG}, {_elevated('10')} SELECT *, CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS severity FROM d1")
def scoring_config(spark, sf_dir):
    return rules.ordered(rules.elevated_errors(rules.message_counts(log(spark, sf_dir)), error_threshold=10, scoring=ScoringConfig(medium_cutoff=70, high_cutoff=90)))


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    new = F.col("timestamp") >= F.timestamp_seconds(F.lit(1705363200))  # 2024-01-16 UTC
    return log(spark, sf_dir).where(~new), log(spark, sf_dir).where(new)


@query("novel_messages", f"WITH {LOG}, {_novel()} SELECT *, {_SEVERITY} FROM d4")
def novel_messages(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    known = rules.message_counts(old).select("source", "level", F.col("key").alias("message"))
    return rules.detect_novel_messages(new, known)


@query(
    "corpus_merge",
    f"""WITH {LOG}, o AS (SELECT source, level, message, count(*) AS n FROM l WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), w AS (SELECT source, level, message, count(*) AS n FROM l WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
SELECT coalesce(o.source, w.source) AS source, coalesce(o.level, w.level) AS level, coalesce(o.message, w.message) AS message, (coalesce(o.n, 0) + coalesce(w.n, 0))::BIGINT AS count, o.level IS NULL AS is_new
FROM o FULL JOIN w ON o.source = w.source AND o.level = w.level AND o.message = w.message""",
)
def corpus_merge(spark, sf_dir):
    old, new = map(rules.message_counts, _halves(spark, sf_dir))
    corpus = old.select("source", "level", F.col("key").alias("message"), F.col("n").alias("count"), F.lit("2024-01-16").alias("first_seen"))
    return novelty.merge(corpus, new).drop("first_seen")


_DIFF = f"""WITH {LOG}, w AS (SELECT time_bucket(INTERVAL '1440 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS s, level, event_id FROM l),
  c AS (SELECT s, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e FROM w WHERE event_id % 2 = 1 GROUP BY s),
  r AS (SELECT s, count(*) AS n, count(*) FILTER (level = 'ERROR') AS e FROM w WHERE event_id % 2 = 0 AND s >= TIMESTAMP '2024-01-04' GROUP BY s),
  d AS (SELECT strftime(coalesce(c.s, r.s), '%Y-%m-%dT%H:%M:%S+00:00') AS window_start, r.e / r.n AS reference_error_rate, c.e / c.n AS current_error_rate, c.e AS error_events FROM c FULL JOIN r ON c.s = r.s)
SELECT window_start, reference_error_rate, current_error_rate, current_error_rate - reference_error_rate AS delta,
  CASE WHEN reference_error_rate IS NULL THEN error_events > 0 WHEN current_error_rate IS NULL THEN false ELSE abs(current_error_rate - reference_error_rate) >= 0.02 END AS finding FROM d"""


def _deltas(spark, sf_dir) -> DataFrame:
    odd = F.col("ord") % 2 == 1
    both = log(spark, sf_dir)
    old = windows.build_time_windows(both.where(~odd & (F.col("timestamp") >= F.timestamp_seconds(F.lit(1704326400)))), window_minutes=1440)
    return windows.window_deltas(windows.build_time_windows(both.where(odd), window_minutes=1440), old, threshold=0.02)


@query("baseline_diff", _DIFF)
def baseline_diff(spark, sf_dir):
    return _deltas(spark, sf_dir).drop("threshold", "error_events")


@query(
    "baseline_findings",
    f"""WITH x AS ({_DIFF}), e AS (SELECT strftime(time_bucket(INTERVAL '1440 minutes', ts::TIMESTAMP, TIMESTAMP '1970-01-01'), '%Y-%m-%dT%H:%M:%S+00:00') AS window_start, count(*) FILTER (event_type = 'error') AS count FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT CASE WHEN delta IS NULL THEN 'baseline-new-window' ELSE 'baseline-drift' END AS rule, count, score, {_SEVERITY},
  CASE WHEN delta IS NULL THEN 'New window ' || window_start || ' with ' || count || ' error events has no reference baseline'
    ELSE 'Error-rate drift in window ' || window_start || ': ' || printf('%.1f%%', 100 * reference_error_rate) || ' -> ' || printf('%.1f%%', 100 * current_error_rate) || ' (delta ' || printf('%+.1f%%', 100 * delta) || ', threshold 2%)' END AS message
FROM (SELECT x.*, e.count, CASE WHEN delta IS NULL THEN 50 ELSE least(100, round_even(50 + 50 * abs(delta), 0))::INTEGER END AS score FROM x JOIN e USING (window_start) WHERE finding)""",
)
def baseline_findings(spark, sf_dir):
    return windows.drift_findings(_deltas(spark, sf_dir))


@query(
    "findings_all",
    f"""WITH {LOG}, {_elevated("10")}, {_repeated(2)}, {_burst(3, 86400)}, a AS (SELECT rule, message, count, score FROM d1 UNION ALL SELECT rule, message, count, score FROM d2 UNION ALL SELECT rule, message, count, score FROM d3)
SELECT *, {_SEVERITY} FROM a""",
)
def findings_all(spark, sf_dir):
    return rules.detect_anomalies(log(spark, sf_dir), error_threshold=10, repeat_threshold=2, burst_threshold=3, burst_window_seconds=86400)


# --- fields ------------------------------------------------------------------------------------------------------------------------

_FIELDS = """f AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'null' WHEN event_id % 2 = 0 THEN 'integer' ELSE 'string' END AS type FROM events WHERE event_id % 7 <> 0),
  a AS (SELECT (SELECT count(*) FROM events) AS n, count(*) AS present, count(*) FILTER (type = 'null') AS nulls, count(*) FILTER (type = 'integer') AS i, count(*) FILTER (type = 'string') AS s FROM f)"""


def _drifting(spark, sf_dir) -> DataFrame:
    e = F.col("ord")
    value = F.when(e % 11 == 0, "null").when(e % 2 == 0, F.col("fields")["k"]).otherwise(F.concat(F.lit('"'), F.col("fields")["k"], F.lit('"')))
    return log(spark, sf_dir).withColumn("fields", F.when(e % 7 == 0, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.create_map(F.lit("k"), value)))


@query(
    "field_coverage",
    f"WITH {_FIELDS} SELECT 'k' AS field, present, n - present AS missing, present / n AS coverage, present - nulls AS populated, (present - nulls) / n AS populated_rate, nulls, nulls / present AS null_rate, i > 0 AND s > 0 AS type_drift FROM a WHERE present > 0",
)
def field_coverage(spark, sf_dir):
    found = coverage.field_coverage(_drifting(spark, sf_dir))
    return found.drop("types", "type_drift_families", "type_drift_family_counts", "type_drift_family_rates")


@query("field_type_drift", f"WITH {_FIELDS} SELECT 'k' AS field, family, n AS count, n / (i + s) AS rate FROM (SELECT unnest(['number', 'string']) AS family, unnest([i, s]) AS n, i, s FROM a)")
def field_type_drift(spark, sf_dir):
    found = coverage.field_coverage(_drifting(spark, sf_dir)).where("type_drift")
    return found.select("field", F.explode("type_drift_family_counts").alias("family", "count"), "type_drift_family_rates").select("field", "family", "count", F.col("type_drift_family_rates")[F.col("family")].alias("rate"))


# --- parsers -----------------------------------------------------------------------------------------------------------------------

_PARSED = f"SELECT event_id, level, message, source, {MICROS} AS micros FROM l"


def _iso(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _raw(spark, sf_dir, line) -> DataFrame:
    """Rendered lines; line makes one from the columns id, kind, k, user, ts."""
    e = spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("user"), F.col("ts")
    )
    return e.select(F.col("id").alias("event_id"), F.lit("events.log").alias("provenance"), line.alias("raw"))


def _rows(lines: DataFrame, format: str) -> DataFrame:
    return events_of(parse_lines(lines, format)).select("event_id", "level", "message", "source", F.unix_micros("timestamp").alias("micros"))


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _message() -> Column:
    return _cat(F.col("kind"), " k=", F.col("k"))


def _level() -> Column:
    return level_of(F.col("kind"))


@query("parse_json", f"WITH {LOG} {_PARSED}")
def parse_json(spark, sf_dir):
    line = _cat('{"timestamp":"', _iso(F.col("ts")), '","level":"', F.lower(_level()), '","source":"user-', F.col("user"), '","message":"', _message(), '","k":', F.col("k"), "}")
    return _rows(_raw(spark, sf_dir, line), "json")


@query("parse_json_otel", f"WITH {LOG} SELECT event_id, level, message, source, (epoch_us(ts) // 1000000) * 1000000 AS micros FROM l")
def parse_json_otel(spark, sf_dir):
    severity = F.when(F.col("kind") == "error", "17").when(F.col("kind") == "purchase", "13").otherwise("9")
    nanos = (F.unix_seconds(utc(F.col("ts")))).cast("string")
    line = _cat(
        '{"timeUnixNano":"', nanos, '000000000","severityNumber":', severity, ',"body":{"stringValue":"', _message(),
        '"},"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"user-', F.col("user"), '"}}]}}',
    )
    return _rows(_raw(spark, sf_dir, line), "json")


@query("parse_json_journald", f"WITH {LOG} SELECT event_id, level, message, source, (epoch_us(ts) // 1000000) * 1000000 AS micros FROM l")
def parse_json_journald(spark, sf_dir):
    priority = F.when(F.col("kind") == "error", "3").when(F.col("kind") == "purchase", "4").otherwise("6")
    line = _cat('{"MESSAGE":"', _message(), '","PRIORITY":"', priority, '","__REALTIME_TIMESTAMP":"', F.unix_seconds(utc(F.col("ts"))).cast("string"), '000000","_SYSTEMD_UNIT":"user-', F.col("user"), '"}')
    return _rows(_raw(spark, sf_dir, line), "json")


def _syslog() -> Column:
    pri = F.when(F.col("kind") == "error", "11").when(F.col("kind") == "purchase", "12").otherwise("14")
    return _cat("<", pri, ">1 ", _iso(F.col("ts")), " host user-", F.col("user"), " ", F.col("id").cast("string"), ' - [meta k="', F.col("k"), '"] ', _message())


@query("parse_rfc5424", f"WITH {LOG} {_PARSED}")
def parse_rfc5424(spark, sf_dir):
    return _rows(_raw(spark, sf_dir, _syslog()), "rfc5424")


@query("parse_rfc5424_errors", "SELECT event_id % 10 = 0 AS failed, count(*) AS n FROM events GROUP BY 1")
def parse_rfc5424_errors(spark, sf_dir):
    lines = _raw(spark, sf_dir, F.when(F.col("id") % 10 == 0, F.replace(_syslog(), F.lit(">1 "), F.lit(">01 "))).otherwise(_syslog()))
    return parse_lines(lines, "rfc5424").groupBy(F.col("parse_error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query("syslog_fields", "SELECT event_id, CASE event_type WHEN 'error' THEN '3' WHEN 'purchase' THEN '4' ELSE '6' END AS severity, '\"user\"' AS facility, '\"' || event_id || '\"' AS procid FROM events")
def syslog_fields(spark, sf_dir):
    found = parse_lines(_raw(spark, sf_dir, _syslog()), "rfc5424")
    return found.select("event_id", F.col("fields")["syslog_severity"].alias("severity"), F.col("fields")["syslog_facility_name"].alias("facility"), F.col("fields")["syslog_procid"].alias("procid"))


_LINE = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' [' || level || '] service=' || source || ' ' || message"


def _text() -> Column:
    return _cat(_iso(F.col("ts")), " [", _level(), "] service=user-", F.col("user"), " ", _message())


@query("parse_text", f"WITH {LOG} SELECT event_id, level, {_LINE} AS message, source, {MICROS} AS micros FROM l")
def parse_text(spark, sf_dir):
    return _rows(_raw(spark, sf_dir, _text()), "text")


_LOGFMT = "'ts=' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' level=' || lower(level) || ' service=\"' || source || '\" msg=\"' || message || '\"'"


@query("parse_logfmt", f"WITH {LOG} SELECT event_id, level, {_LOGFMT} AS message, source, {MICROS} AS micros FROM l")
def parse_logfmt(spark, sf_dir):
    line = _cat("ts=", _iso(F.col("ts")), " level=", F.lower(_level()), ' service="user-', F.col("user"), '" msg="', _message(), '"')
    return _rows(_raw(spark, sf_dir, line), "text")


@query("parse_auto", f"WITH {LOG} SELECT event_id, level, CASE WHEN event_id % 2 = 0 THEN message ELSE {_LINE} END AS message, source, {MICROS} AS micros FROM l")
def parse_auto(spark, sf_dir):
    as_json = _cat('{"time":"', _iso(F.col("ts")), '","severity":"', _level(), '","service":"user-', F.col("user"), '","msg":"', _message(), '"}')
    return _rows(_raw(spark, sf_dir, F.when(F.col("id") % 2 == 0, as_json).otherwise(_text())), "auto")


@query("message_counts", f"WITH {LOG} SELECT source, level, message AS key, count(*) AS n, arg_min(message, event_id) AS evidence FROM l GROUP BY source, level, message")
def message_counts(spark, sf_dir):
    return rules.message_counts(log(spark, sf_dir)).drop("ord")


@query("normalize_sources", f"WITH {LOG} SELECT DISTINCT source AS given, 'USER ' || substr(source, 6) AS display, 'USER' || substr(source, 6) AS rule FROM l")
def normalize_sources(spark, sf_dir):
    wide = F.concat(F.lit(" ＵＳＥＲ\t"), F.substring("source", 6, 20), F.lit("​"))
    return log(spark, sf_dir).select(F.col("source").alias("given"), text.display_source(wide).alias("display"), text.rule_source(wide).alias("rule")).distinct()


@query("normalize_messages", f"WITH {LOG} SELECT DISTINCT message AS given, message AS rule, upper(message || ' x') AS shown FROM l")
def normalize_messages(spark, sf_dir):
    message = F.col("message")
    return log(spark, sf_dir).select(
        message.alias("given"), text.rule_message(F.concat(F.lit("  "), message, F.lit("​ "))).alias("rule"), F.upper(text.filter_message(F.concat(message, F.lit("\tx")))).alias("shown")
    ).distinct()


from quarrylog.plans import cases  # noqa: E402, F401  registers its queries
