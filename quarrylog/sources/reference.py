"""Reference windows from a saved report, or from a bare {"windows": [...]} object. Read on the driver: a row per window."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quarrylog.operators.windows import BaselineDiffError

SCHEMA = "position long, start string, events long, error_events long"


def _whole(value: object) -> int:
    if isinstance(value, bool):
        raise ValueError("must be an integer")
    return int(value)


def load_reference_windows(path: str | Path) -> tuple[list[dict], int | None]:
    """The windows (start, events, error_events) and the window's minutes, if the file tells."""
    fail = lambda why: BaselineDiffError(f"baseline reference {path}: {why}")
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise fail("not found") from None
    except OSError as e:
        raise fail(f"cannot be read: {e}") from e
    except ValueError as e:
        raise fail(f"invalid JSON: {e}") from e
    if not isinstance(data, dict):
        raise fail("must hold a JSON object")
    baseline, minutes = data.get("time_baseline"), None
    if isinstance(baseline, dict):
        rows, minutes = baseline.get("windows", []), baseline.get("window_minutes")
    elif "windows" in data:
        rows = data["windows"]
    else:
        raise fail("has neither time_baseline.windows nor windows; save a report with --window-minutes first")
    if not isinstance(rows, list):
        raise fail("windows must be a list")
    out = []
    for row in rows:
        if not isinstance(row, dict):
            raise fail("window entries must be objects")
        try:
            entry = {"start": str(row["start"]), "events": _whole(row["events"]), "error_events": _whole(row["error_events"])}
        except (KeyError, TypeError, ValueError) as e:
            raise fail(f"window entries need start, events and error_events ({e})") from e
        if min(entry["events"], entry["error_events"]) < 0:
            raise fail("window counts must be non-negative")
        out.append(entry)
    return out, minutes if type(minutes) is int else None


def reference_table(spark: SparkSession, windows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(k, w["start"], w["events"], w["error_events"]) for k, w in enumerate(windows)], SCHEMA)
