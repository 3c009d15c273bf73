"""Fixed values of the log formats: severity names, aliases and numbers, and the keys each format reads."""

from __future__ import annotations

# The severities that events carry, and other names for them.
LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "ERROR", "CRITICAL")
ALIASES = {
    "WARNING": "WARN",
    "ERR": "ERROR",
    "FATAL": "CRITICAL",
    "CRIT": "CRITICAL",
    "ALERT": "CRITICAL",
    "EMERG": "CRITICAL",
    "EMERGENCY": "CRITICAL",
    "INFORMATION": "INFO",
    "INFORMATIONAL": "INFO",
}
UNKNOWN = "UNKNOWN"
# Syslog and journal priorities 0 to 7.
PRIORITY_LEVELS = ("CRITICAL", "CRITICAL", "CRITICAL", "ERROR", "WARN", "NOTICE", "INFO", "DEBUG")
PRIORITY_NAMES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")
# Syslog facilities 0 to 23.
FACILITY_NAMES = (
    "kernel", "user", "mail", "system", "security", "syslog", "printer", "network-news", "uucp", "clock", "security-2", "ftp",
    "ntp", "log-audit", "log-alert", "clock-2", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
# Severity numbers 1 to 24, four to a level.
SEVERITY_NUMBER_LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")

# Keys of JSON records in the order in which they are tried.
MESSAGE_KEYS = ("message", "msg", "body", "MESSAGE")
LEVEL_KEYS = ("level", "severity", "log.level", "severity_text", "severityText")
TIME_KEYS = ("timestamp", "time", "@timestamp", "ts")
OBSERVED_KEYS = ("observed_timestamp", "observedTimestamp")
SOURCE_KEYS = ("source", "service", "component", "logger")
JOURNAL_SOURCE_KEYS = ("_SYSTEMD_UNIT", "SYSLOG_IDENTIFIER", "_COMM")
RESERVED_KEYS = (
    *MESSAGE_KEYS, *LEVEL_KEYS, "severityNumber", "PRIORITY", *TIME_KEYS, "timeUnixNano", *OBSERVED_KEYS,
    "observedTimeUnixNano", "__REALTIME_TIMESTAMP", *SOURCE_KEYS,
)
# Keys of key=value tokens, in lower case.
TEXT_LEVEL_KEYS, TEXT_TIME_KEYS = ("level", "severity"), ("ts", "timestamp", "time")
TEXT_RESERVED_KEYS = (*TEXT_LEVEL_KEYS, *TEXT_TIME_KEYS, *SOURCE_KEYS)
