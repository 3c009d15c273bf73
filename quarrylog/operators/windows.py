"""Tumbling UTC windows and their comparison with a reference."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.functions.scoring import ScoringConfig, severity
from quarrylog.functions.text import arrow, is_error, level_key
from quarrylog.operators.summary import histogram

_ISO = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


class BaselineDiffError(ValueError):
    """A reference that can't be read or compared."""


def check_window_minutes(minutes: object) -> int:
    if type(minutes) is not int or not 1 <= minutes <= 1440:
        raise ValueError("window_minutes must be an integer between 1 and 1440")
    return minutes


def _iso(micros):
    # seconds and offset in UTC, whatever the session's time zone is
    return F.date_format(F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone()), _ISO)


def window_level_counts(events: DataFrame, *, window_minutes: int = 5) -> DataFrame:
    """start (seconds since the epoch), level, n of the events with a timestamp."""
    step = check_window_minutes(window_minutes) * 60
    timed = events.where(F.col("timestamp").isNotNull())
    # whole seconds towards zero, which before 1970 isn't the floor
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    seconds = F.when(micros < 0, -F.floor(-micros / 1_000_000)).otherwise(F.floor(micros / 1_000_000)).cast("long")
    return timed.groupBy((seconds - F.pmod(seconds, F.lit(step))).alias("start"), level_key(F.col("level")).alias("level")).agg(F.count("*").alias("n"))


def build_time_windows(events: DataFrame, *, window_minutes: int = 5) -> DataFrame:
    """start, end (ISO texts), events, error_events, levels of each window that has events."""
    counts = window_level_counts(events, window_minutes=window_minutes)
    found = counts.groupBy("start").agg(F.sum("n").alias("events"), F.sum(F.when(is_error(F.col("level")), F.col("n")).otherwise(0)).alias("error_events"), histogram("level").alias("levels"))
    return found.orderBy("start").select(_iso(F.col("start") * 1_000_000).alias("start"), _iso((F.col("start") + window_minutes * 60) * 1_000_000).alias("end"), "events", "error_events", "levels")


@arrow("string")
def _drift_text(start: pa.Array, before: pa.Array, now: pa.Array, delta: pa.Array, threshold: pa.Array) -> pa.Array:
    rows = zip(*(x.to_pylist() for x in (start, before, now, delta, threshold)), strict=True)
    return pa.array([None if d is None else f"Error-rate drift in window {s}: {b:.1%} -> {n:.1%} (delta {d:+.1%}, threshold {t:.0%})" for s, b, n, d, t in rows], pa.string())


def check_diff_threshold(threshold: object) -> float:
    if type(threshold) not in (int, float) or math.isnan(threshold) or not 0 <= threshold <= 1:
        raise BaselineDiffError(f"the threshold must be a number between 0 and 1, got {threshold!r}")
    return threshold


def window_deltas(current: DataFrame, reference: DataFrame, *, threshold: float) -> DataFrame:
    """A full outer join on the start's text (of repeated starts one row counts): window_start, both rates, delta, threshold, finding, error_events."""
    check_diff_threshold(threshold)
    rate = F.when(F.col("events") > 0, F.col("error_events") / F.col("events")).otherwise(0.0)

    def rates(windows: DataFrame, name: str) -> DataFrame:
        # of repeated starts the last in the table's order counts
        if "position" not in windows.columns:
            windows = windows.withColumn("position", F.monotonically_increasing_id())
        last = windows.select("start", rate.alias("rate"), F.col("error_events").cast("long").alias("errors"), F.col("position").alias("at"))
        last = last.groupBy("start").agg(F.max_by(F.struct("rate", "errors"), "at").alias("w"))
        return last.select("start", F.col("w.rate").alias(name), F.col("w.errors").alias(f"{name}_errors"))

    both = rates(current, "now").join(rates(reference, "before"), "start", "full_outer")
    delta = F.col("now") - F.col("before")
    found = F.when(delta.isNotNull(), F.abs(delta) >= threshold).otherwise(F.coalesce(F.col("before").isNull() & (F.col("now_errors") > 0), F.lit(False)))
    return both.select(
        F.col("start").alias("window_start"), F.col("before").alias("reference_error_rate"), F.col("now").alias("current_error_rate"),
        delta.alias("delta"), F.lit(float(threshold)).alias("threshold"), found.alias("finding"), F.col("now_errors").alias("error_events"),
    ).orderBy("window_start")


def drift_findings(deltas: DataFrame, scoring: ScoringConfig | None = None) -> DataFrame:
    """rule, severity, message, count, score of the deltas that are findings, in order of their windows."""
    scoring = scoring or ScoringConfig()
    drift = F.col("delta").isNotNull()
    points = F.when(drift, F.least(F.lit(100), F.bround(50 + 50 * F.abs(F.col("delta"))))).otherwise(scoring.base_points).cast("int")
    drifted = _drift_text("window_start", "reference_error_rate", "current_error_rate", "delta", "threshold")
    new = F.concat(F.lit("New window "), F.col("window_start"), F.lit(" with "), F.col("error_events").cast("string"), F.lit(" error events has no reference baseline"))
    found = deltas.where("finding").withColumn("score", points)
    return found.orderBy("window_start").select(
        F.when(drift, "baseline-drift").otherwise("baseline-new-window").alias("rule"), severity(F.col("score"), scoring).alias("severity"),
        F.when(drift, drifted).otherwise(new).alias("message"), F.col("error_events").alias("count"), "score",
    )


def diff_time_windows(current: DataFrame, reference: DataFrame, *, threshold: float, scoring: ScoringConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings and deltas of current windows against a reference's (start, events, error_events)."""
    deltas = window_deltas(current, reference, threshold=threshold)
    return drift_findings(deltas, scoring), deltas.drop("error_events")
