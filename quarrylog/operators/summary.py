"""Histograms and source health, all from one table of counts per (source, level)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylog.functions.text import arrow, display_source, is_error, level_key


def histogram(key: str, count: str = "n"):
    """A map from key to count in order of the key."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(count).alias("value")))))


def level_counts(events: DataFrame) -> DataFrame:
    """source (display identity), level, n: the one shuffle below, partly summed before it."""
    return events.groupBy(display_source(F.col("source")).alias("source"), level_key(F.col("level")).alias("level")).agg(F.count("*").alias("n"))


def level_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(level_key(F.col("level")).alias("level")).agg(F.count("*").alias("events"))


def source_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy(display_source(F.col("source")).alias("source")).agg(F.count("*").alias("events"))


def summarize(events: DataFrame) -> DataFrame:
    """One row: events, levels, sources."""
    counts = level_counts(events)
    # one row per level or source on the way to a single row
    levels = counts.groupBy("level").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), histogram("level").alias("levels"))
    sources = counts.groupBy("source").agg(F.sum("n").alias("n")).agg(histogram("source").alias("sources"))
    return levels.withColumn("_", F.lit(1)).join(sources.withColumn("_", F.lit(1)), "_").drop("_")


def source_health(events: DataFrame) -> DataFrame:
    """source, events, error_events, error_rate, levels, in order of source."""
    return health_of(level_counts(events))


def health_of(counts: DataFrame) -> DataFrame:
    found = counts.groupBy("source").agg(F.sum("n").alias("events"), F.sum(F.when(is_error(F.col("level")), F.col("n")).otherwise(0)).alias("error_events"), histogram("level").alias("levels"))
    return found.select("source", "events", "error_events", (F.col("error_events") / F.col("events")).alias("error_rate"), "levels").orderBy("source")


@arrow("double")
def _rounded(rates: pa.Array) -> pa.Array:
    # four decimals of the binary value, as round() gives; bround() rounds its decimal text
    return pa.array([None if r is None else round(r, 4) for r in rates.to_pylist()], pa.float64())


def summarize_sources(events: DataFrame) -> DataFrame:
    """source_health with rates of four decimals."""
    return source_health(events).withColumn("error_rate", _rounded("error_rate"))


def concentrated_error_sources(events: DataFrame, *, min_errors: int = 3, min_error_rate: float = 0.5) -> DataFrame:
    """The sources with at least min_errors errors and at least that error rate."""
    if type(min_errors) is not int or min_errors < 1:
        raise ValueError("min_errors must be an integer >= 1")
    if type(min_error_rate) not in (int, float) or math.isnan(min_error_rate) or not 0 <= min_error_rate <= 1:
        raise ValueError("min_error_rate must be a number between 0 and 1")
    return source_health(events).where((F.col("error_events") >= min_errors) & (F.col("error_rate") >= min_error_rate))
