"""Detection rules over one table of message counts, with transparent scores.

message_counts is the one shuffle of many keys; sources' and levels' totals are summed from it, and joined to the few rows that reach a
threshold, so that no window holds all messages of a source. Bursts are counted per source and stretch of time (bursts).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import pyarrow as pa
import unicodedata
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.functions import text
from quarrylog.functions.scoring import THRESHOLDS, ScoringConfig, SourceThresholds, score, severity
from quarrylog.sources.storage import shared_folder

COLUMNS = ("rule", "severity", "message", "count", "score")
ORDER = ("_rule", "_source", "_level", "_key")
_SEPARATE = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"
Overrides = Mapping[str, SourceThresholds]

# --- text of findings --------------------------------------------------------------------------------------------------


def escaped_text(value: str) -> str:
    """Control and format characters made visible."""
    def show(c: str) -> str:
        if c in "\n\r\t":
            return {"\n": r"\n", "\r": r"\r", "\t": r"\t"}[c]
        if unicodedata.category(c) not in ("Cc", "Cf", "Zl", "Zp"):
            return c
        n = ord(c)
        return f"\\x{n:02x}" if n < 0x100 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"

    return "".join(map(show, value))


@text.arrow("string")
def _escaped(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else escaped_text(v) for v in values.to_pylist()], pa.string())


@text.arrow("string")
def _general(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else f"{v:g}" for v in values.to_pylist()], pa.string())


def shown(value: Column, scoring: ScoringConfig) -> Column:
    """value as findings show it: escaped, and cut to the configured length."""
    odd = value.rlike(_SEPARATE)
    full = F.when(odd, _escaped(F.when(odd, value))).otherwise(value)
    limit = scoring.max_finding_context
    # a limit below 3 takes characters off the end instead, as a negative slice does
    keep = F.lit(limit - 3) if limit >= 3 else F.greatest(F.lit(0), F.length(full) + (limit - 3))
    return F.when(F.length(full) <= limit, full).otherwise(F.concat(F.substring(full, F.lit(1), keep), F.lit("...")))


def _about(source: Column, scoring: ScoringConfig) -> Column:
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit(" ["), shown(source, scoring), F.lit("]")))


# --- counts --------------------------------------------------------------------------------------------------------------


def message_counts(events: DataFrame) -> DataFrame:
    """source, level, key (normalised message, maybe empty), n, evidence (the first such message, stripped), ord (its place)."""
    if "ord" not in events.columns:
        events = events.withColumn("ord", F.monotonically_increasing_id())
    first = F.min_by(text.stripped(F.col("message")), F.col("ord"))
    keys = (text.rule_source(F.col("source")).alias("source"), text.level_key(F.col("level")).alias("level"), text.rule_message(F.col("message")).alias("key"))
    return events.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("evidence"), F.min("ord").alias("ord"))


def summed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """message_counts and error_moments from one pass over the events and one shuffle, by way of a table in the shared folder."""
    if "ord" not in events.columns:
        events = events.withColumn("ord", F.monotonically_increasing_id())
    keyed = events.select(
        text.rule_source(F.col("source")).alias("source"), text.level_key(F.col("level")).alias("level"), text.rule_message(F.col("message")).alias("key"),
        text.stripped(F.col("message")).alias("evidence"), "ord", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"),
    )
    none = lambda name: F.lit(None).cast(keyed.schema[name].dataType).alias(name)
    message = F.struct(F.lit(0).alias("kind"), "source", "level", "key", none("t"), "evidence", "ord")
    moment = F.struct(F.lit(1).alias("kind"), "source", none("level"), none("key"), "t", none("evidence"), none("ord"))
    units = keyed.select(F.explode(F.when(text.is_error(F.col("level")) & F.col("t").isNotNull(), F.array(message, moment)).otherwise(F.array(message))).alias("u")).select("u.*")
    table = units.groupBy("kind", "source", "level", "key", "t").agg(F.count("*").alias("n"), F.min_by("evidence", "ord").alias("evidence"), F.min("ord").alias("ord"))
    path = shared_folder(events.sparkSession, "findings")
    table.write.partitionBy("kind").parquet(path)
    read = lambda kind, *names: events.sparkSession.read.schema(table.schema).parquet(path).where(F.col("kind") == kind).select(*names)
    return read(0, "source", "level", "key", "n", "evidence", "ord"), read(1, "source", "t", "n")


def source_totals(counts: DataFrame) -> DataFrame:
    errors = F.sum(F.when(text.is_error(F.col("level")), F.col("n")).otherwise(0))
    return counts.groupBy("source").agg(F.sum("n").alias("total"), errors.alias("errors"))


def scope_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("source", "level").agg(F.sum("n").alias("total"))


def limit_of(name: str, default: int, overrides: Overrides | None, source: Column) -> Column:
    """The threshold of each source; overrides come from a policy file and are literals of the plan."""
    own = {s: getattr(t, name) for s, t in (overrides or {}).items() if getattr(t, name) is not None}
    if not own:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), source), F.lit(default))


def _finding(rule: int, name: str, message: Column, count: Column, points: Column, scoring: ScoringConfig, level: Column | None = None, key: Column | None = None) -> list[Column]:
    blank = F.lit("")
    return [
        F.lit(name).alias("rule"), severity(points, scoring).alias("severity"), message.alias("message"), count.cast("long").alias("count"), points.alias("score"),
        F.lit(rule).alias("_rule"), F.coalesce("source", blank).alias("_source"), (blank if level is None else level).alias("_level"), (blank if key is None else key).alias("_key"),
    ]


# --- rules ---------------------------------------------------------------------------------------------------------------


def elevated_errors(counts: DataFrame, *, error_threshold: int = 5, scoring: ScoringConfig | None = None, overrides: Overrides | None = None) -> DataFrame:
    scoring, limit = scoring or ScoringConfig(), limit_of("error_threshold", error_threshold, overrides, F.col("source"))
    found = source_totals(counts).where((F.col("errors") > 0) & (F.col("errors") >= limit))
    message = F.concat(F.lit("Elevated error-level event count"), _about(F.col("source"), scoring))
    return found.select(*_finding(1, "elevated-errors", message, F.col("errors"), score(F.col("errors"), limit, F.col("total"), scoring), scoring))


def _with_scope(rows: DataFrame, counts: DataFrame) -> DataFrame:
    totals = scope_totals(counts).select(F.col("source").alias("_s"), F.col("level").alias("_l"), "total")
    return rows.join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l"))).drop("_s", "_l")


def _message_findings(rule: int, name: str, label: str, found: DataFrame, limit: Column, scoring: ScoringConfig) -> DataFrame:
    message = F.concat(F.lit(label), _about(F.col("source"), scoring), F.lit(": "), shown(F.col("evidence"), scoring))
    points = score(F.col("n"), limit, F.col("total"), scoring)
    return found.select(*_finding(rule, name, message, F.col("n"), points, scoring, F.col("level"), F.col("key")))


def repeated_messages(counts: DataFrame, *, repeat_threshold: int = 5, scoring: ScoringConfig | None = None, overrides: Overrides | None = None) -> DataFrame:
    limit = limit_of("repeat_threshold", repeat_threshold, overrides, F.col("source"))
    found = counts.where((F.col("key") != "") & (F.col("n") >= limit))
    return _message_findings(2, "repeated-message", "Repeated message", _with_scope(found, counts), limit, scoring or ScoringConfig())


#: A stretch of time in which bursts are counted together, in burst windows.
STRETCH = 64


def error_moments(events: DataFrame) -> DataFrame:
    """source, t (microseconds), n: the errors of each moment."""
    errors = events.where(text.is_error(text.level_key(F.col("level"))) & F.col("timestamp").isNotNull())
    return errors.groupBy(text.rule_source(F.col("source")).alias("source"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t")).agg(F.count("*").alias("n"))


def bursts(moments: DataFrame, *, burst_window_seconds: int = 60, overrides: Overrides | None = None) -> DataFrame:
    """source, n, span (microseconds): the most errors in any closed interval of the window's length, and the least span that holds so many.

    A moment's errors enter a running sum at its time and leave just after the window's length; the sum then is the count of the
    window that ends there, at a constant cost for each moment. Time is cut into stretches, each with the window before it as
    context, so that a source with most errors still spreads over tasks. Equal moments are summed before (error_moments).
    """
    at = moments.withColumn("w", limit_of("burst_window_seconds", burst_window_seconds, overrides, F.col("source")).cast("long") * 1_000_000)
    own = F.floor(F.col("t") / (F.col("w") * STRETCH)).cast("long")
    again = (own + 1) * F.col("w") * STRETCH - F.col("t") <= F.col("w")
    at = at.withColumn("own", own).withColumn("stretch", F.explode(F.when(again, F.array(own, own + 1)).otherwise(F.array(own))))
    group = Window.partitionBy("source", "stretch")
    at = at.withColumn("next", F.lead("t").over(group.orderBy("t")))
    point = F.struct(F.col("t").alias("time"), F.lit(1).alias("enters"), F.col("n").alias("change"), F.col("t").alias("point"), F.lit(None).cast("long").alias("edge"))
    leave = F.struct((F.col("t") + F.col("w") + 1).alias("time"), F.lit(0).alias("enters"), (-F.col("n")).alias("change"), F.lit(None).cast("long").alias("point"), F.col("next").alias("edge"))
    moves = at.select("source", "stretch", F.col("own"), F.explode(F.array(point, leave)).alias("m")).select("source", "stretch", "own", "m.*")
    so_far = group.orderBy("time", "enters").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windows = moves.select("source", "stretch", "own", "point", F.sum("change").over(so_far).alias("n"), F.coalesce(F.max("edge").over(so_far), F.min("point").over(so_far)).alias("left"))
    ends = windows.where(F.col("point").isNotNull() & (F.col("own") == F.col("stretch")))
    best = ends.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("less"), (F.col("point") - F.col("left")).alias("span"))).alias("b"))
    return best.select("source", (-F.col("b.less")).alias("n"), F.col("b.span").alias("span"))


def error_bursts(
    moments: DataFrame, counts: DataFrame, *, burst_threshold: int = 5, burst_window_seconds: int = 60, scoring: ScoringConfig | None = None, overrides: Overrides | None = None
) -> DataFrame:
    scoring, source = scoring or ScoringConfig(), F.col("source")
    limit = limit_of("burst_threshold", burst_threshold, overrides, source)
    window = limit_of("burst_window_seconds", burst_window_seconds, overrides, source)
    found = bursts(moments, burst_window_seconds=burst_window_seconds, overrides=overrides).where(F.col("n") >= limit)
    totals = source_totals(counts).select(source.alias("_s"), "total")
    found = found.join(totals, source.eqNullSafe(F.col("_s"))).drop("_s")
    message = F.concat(
        F.lit("Error burst"), _about(source, scoring), F.lit(": "), F.col("n").cast("string"), F.lit(" events in "),
        _general(F.col("span") / 1_000_000), F.lit("s (configured window "), window.cast("string"), F.lit("s)"),
    )
    return found.select(*_finding(3, "error-burst", message, F.col("n"), score(F.col("n"), limit, F.col("total"), scoring), scoring))


def novel_messages(counts: DataFrame, known: DataFrame, *, scoring: ScoringConfig | None = None) -> DataFrame:
    """known: source, level, message (normalised keys). A null source matches a null source."""
    keys = known.select(F.col("source").alias("_s"), F.col("level").alias("_l"), F.col("message").alias("_m"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l")) & (F.col("key") == F.col("_m"))
    found = counts.where(F.col("key") != "").join(keys, same, "left_anti")
    return _message_findings(4, "novel-message", "Novel message", _with_scope(found, counts), F.lit(1), scoring or ScoringConfig())


# --- entry points --------------------------------------------------------------------------------------------------------


def check_thresholds(**values: object) -> None:
    if any(type(v) is not int for v in values.values()):
        raise ValueError("thresholds must be integers")
    if any(v < THRESHOLDS[k] for k, v in values.items()):
        raise ValueError("thresholds must be at least " + ", ".join(f"{THRESHOLDS[k]} for {k}" for k in values))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER).select(*COLUMNS)


def all_findings(
    events: DataFrame, *, error_threshold: int = 5, repeat_threshold: int = 5, burst_threshold: int = 5, burst_window_seconds: int = 60,
    scoring: ScoringConfig | None = None, source_overrides: Overrides | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """The findings of all rules (novel messages if there is a corpus), with the columns ORDER."""
    thresholds = {"error_threshold": error_threshold, "repeat_threshold": repeat_threshold, "burst_threshold": burst_threshold, "burst_window_seconds": burst_window_seconds}
    check_thresholds(**thresholds)
    return findings_of(*summed(events), **thresholds, scoring=scoring, source_overrides=source_overrides, known=known)


def findings_of(
    counts: DataFrame, moments: DataFrame, *, error_threshold: int, repeat_threshold: int, burst_threshold: int, burst_window_seconds: int,
    scoring: ScoringConfig | None = None, source_overrides: Overrides | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """The rules over counts and moments that are there already."""
    more = {"scoring": scoring, "overrides": source_overrides}
    parts = [
        elevated_errors(counts, error_threshold=error_threshold, **more),
        repeated_messages(counts, repeat_threshold=repeat_threshold, **more),
        error_bursts(moments, counts, burst_threshold=burst_threshold, burst_window_seconds=burst_window_seconds, **more),
    ]
    if known is not None:
        parts.append(novel_messages(counts, known, scoring=scoring))
    return reduce(DataFrame.unionByName, parts)


def detect_anomalies(events: DataFrame, **options) -> DataFrame:
    """rule, severity, message, count, score in the order of rules, sources, levels and messages."""
    return ordered(all_findings(events, **options))


def detect_novel_messages(events: DataFrame, known: DataFrame, *, scoring: ScoringConfig | None = None) -> DataFrame:
    return ordered(novel_messages(message_counts(events), known, scoring=scoring))
