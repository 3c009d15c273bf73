"""The library's public names in one place."""

from quarrylog.functions.scoring import ScoringConfig, SourceThresholds
from quarrylog.operators.coverage import field_coverage as summarize_field_coverage
from quarrylog.operators.filters import filter_events
from quarrylog.operators.novelty import KnownCorpus, NoveltyError, corpus_key
from quarrylog.operators.rules import detect_anomalies, detect_novel_messages, message_counts
from quarrylog.operators.summary import concentrated_error_sources, source_health, summarize, summarize_sources
from quarrylog.operators.windows import BaselineDiffError, build_time_windows, diff_time_windows
from quarrylog.plans.policy import ConfigError, DetectionPolicy, load_policies, resolve_policy
from quarrylog.plans.report import Analysis, PipelineConfig
from quarrylog.plans.sinks import report_to_csv, report_to_json, report_to_json_line, report_to_text
from quarrylog.sources.reader import events_of, parse_lines, read_lines, read_logs
from quarrylog.sources.reference import load_reference_windows, reference_table
from quarrylog.streaming.tail import Watch, lines_of

__all__ = [
    "Analysis", "BaselineDiffError", "ConfigError", "DetectionPolicy", "KnownCorpus", "NoveltyError", "PipelineConfig", "ScoringConfig", "SourceThresholds",
    "Watch", "build_time_windows", "concentrated_error_sources", "corpus_key", "detect_anomalies", "detect_novel_messages", "diff_time_windows", "events_of",
    "filter_events", "lines_of", "load_policies", "load_reference_windows", "message_counts", "parse_lines", "read_lines", "read_logs", "reference_table",
    "report_to_csv", "report_to_json", "report_to_json_line", "report_to_text", "resolve_policy", "source_health", "summarize", "summarize_field_coverage",
    "summarize_sources",
]
