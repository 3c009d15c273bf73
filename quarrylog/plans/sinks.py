"""Reports as JSON, CSV and text. A report is small, so these run on the driver."""

from __future__ import annotations

import csv
import io
import json
import math
import unicodedata
from collections.abc import Iterator


def report_to_json(report: dict) -> str:
    return json.dumps(report, indent=2, sort_keys=True, allow_nan=False)


def report_to_json_line(report: dict) -> str:
    return json.dumps(report, sort_keys=True, allow_nan=False)


def _compact(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _visible(c: str) -> str:
    n = ord(c)
    if c in "\n\r\t":
        return {"\n": r"\n", "\r": r"\r", "\t": r"\t"}[c]
    if n < 32 or n == 127:
        return f"\\x{n:02x}"
    if unicodedata.category(c) in ("Cf", "Zl", "Zp"):
        return f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"
    return c


def csv_cell(value: object) -> object:
    """A cell on one line that no spreadsheet takes for a formula; numbers must be finite."""
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("CSV reports hold finite numbers only")
    if not isinstance(value, str):
        return value
    shown = "".join(map(_visible, value))
    return f"'{shown}" if value.lstrip()[:1] in ("=", "+", "-", "@") and value.strip() else shown


#: What a field's details hold in its CSV row.
_DETAILS = ("missing", "populated", "populated_rate", "nulls", "null_rate", "types", "type_drift", "type_drift_families", "type_drift_family_counts", "type_drift_family_rates")


def _csv_rows(report: dict) -> Iterator[tuple]:
    """record_type, name, value, severity, score, message, section by section."""
    for name in ("source", "input_events", "matched_events", "parse_errors", "max_parse_errors", "events"):
        if name in report:
            yield "summary", name, report[name]
    for item in sorted(report.get("detection_config", {}).items()):
        yield "config", *item
    baseline = report.get("time_baseline")
    if isinstance(baseline, dict):
        for name in ("window_minutes", "timestamped_events"):
            if name in baseline:
                yield "baseline", name, baseline[name]
        for w in baseline.get("windows", ()):
            yield "window", w.get("start", ""), w.get("events", ""), "", w.get("error_events", ""), _compact(w.get("levels", {}))
            if w.get("end", "") != "":
                yield "window_end", w.get("start", ""), w["end"]
    for kind, counts in (("level", "levels"), ("source", "sources")):
        for item in sorted(report.get(counts, {}).items()):
            yield kind, *item
    for s in report.get("source_health", ()):
        yield "source_health", s.get("source", ""), s.get("events", ""), s.get("error_rate", ""), s.get("error_events", ""), _compact(s.get("levels", {}))
    fields = report.get("field_coverage")
    if isinstance(fields, dict):
        if "events" in fields:
            yield "field_coverage_meta", "events", fields["events"]
        named = fields.get("fields", {})
        for name, stats in sorted(named.items(), key=lambda kv: str(kv[0])) if isinstance(named, dict) else ():
            if isinstance(stats, dict):
                details = {"types": {}} | {k: stats[k] for k in _DETAILS if k in stats}
                yield "field_coverage", str(name), stats.get("present", ""), "", stats.get("coverage", ""), _compact(details)
    for f in report.get("findings", ()):
        yield "finding", *(f.get(k, "") for k in ("rule", "count", "severity", "score", "message"))


def report_to_csv(report: dict) -> str:
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(("record_type", "name", "value", "severity", "score", "message"))
    for row in _csv_rows(report):
        writer.writerow([csv_cell(c) for c in (*row, *[""] * (6 - len(row)))])
    return out.getvalue()


def report_to_text(report: dict, title: str = "Log report") -> str:
    out = [f"{title}: {report['source']}", f"Input: {report['input_events']} | Matched: {report['matched_events']} | Parse errors: {report['parse_errors']}"]
    out += [f"{level:>8}: {n}" for level, n in report["levels"].items()]
    if report["source_health"]:
        out.append("Source health:")
        out += [f"  {s['source']}: {s['events']} events | {s['error_events']} errors | {s['error_rate']:.1%} error rate" for s in report["source_health"]]
    if b := report.get("time_baseline"):
        out.append(f"Time windows: {len(b['windows'])} x {b['window_minutes']}m | Timestamped: {b['timestamped_events']}")
    if d := report.get("baseline_diff"):
        out.append(f"Baseline diff vs {d['reference']}: {d['drifted_windows']} drifted of {d['compared_windows']} windows")
        for x in (x for x in d["deltas"] if x["finding"]):
            change = "no reference window" if x["delta"] is None else f"{x['reference_error_rate']:.1%} -> {x['current_error_rate']:.1%} (delta {x['delta']:+.1%})"
            out.append(f"  {x['window_start']}: {change}")
    if report["findings"]:
        out.append("Findings:")
        out += [finding_line(f) for f in report["findings"]]
    return "\n".join(out)


def finding_line(f: dict) -> str:
    return f"  [{f['severity']}] {f['rule']}: {f['message']} ({f['count']})"
