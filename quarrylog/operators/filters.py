"""Event filters by level, source and message text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions import text


def predicate(levels: Iterable[str] | None = None, contains: str | None = None, sources: Iterable[str] | None = None) -> Column:
    """All given criteria; an empty one holds for every event. Criteria are normalised once, on the driver, as the events' values are."""
    test = F.lit(True)
    if levels := set(levels or ()):
        test = test & text.level_key(F.col("level")).isin(sorted(map(text.level_text, levels)))
    if contains:
        test = test & F.contains(text.filter_message(F.col("message")), F.lit(text.filter_message_text(contains)))
    if sources := set(sources or ()):
        keys = {(text.display_text(s) or text.UNKNOWN_SOURCE).casefold() for s in sources}
        test = test & text.filter_source(F.col("source")).isin(sorted(keys))
    return test


def filter_events(events: DataFrame, *, levels: Iterable[str] | None = None, contains: str | None = None, sources: Iterable[str] | None = None) -> DataFrame:
    return events.where(predicate(levels, contains, sources))
