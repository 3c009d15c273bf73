import random
from datetime import timedelta

import pytest

from quarrylog.functions.scoring import ScoringConfig, SourceThresholds
from quarrylog.operators import coverage, filters, novelty, rules, summary, windows
from tests.helpers import START, events

rows = lambda df: [tuple(r) for r in df.collect()]


def test_elevated_errors(spark):
    assert rows(rules.detect_anomalies(events(spark, *[{}] * 5))) == [("elevated-errors", "medium", "Elevated error-level event count", 5, 75)]
    scores = lambda n: rules.detect_anomalies(events(spark, *[{}] * n, *[{"l": "INFO"}] * 5)).first()["score"]
    assert (scores(5), scores(10)) == (62, 92)
    assert rows(rules.detect_anomalies(events(spark, *[{}] * 3, {"l": "INFO"}), error_threshold=2)) == [("elevated-errors", "high", "Elevated error-level event count", 3, 81)]


def test_repeated_messages(spark):
    many = events(spark, *[{"l": "WARN", "m": "same"}] * 5, *[{"l": "WARN"}] * 95)
    assert rows(rules.detect_anomalies(many)) == [("repeated-message", "low", "Repeated message: same", 5, 51)]
    spellings = ("retry café", "retry café", "ｒｅｔｒｙ café", "retry​ café", "  retry café")
    assert rows(rules.detect_anomalies(events(spark, *({"m": m, "l": "INFO"} for m in spellings)))) == [("repeated-message", "medium", "Repeated message: retry café", 5, 75)]


@pytest.mark.parametrize(
    "at, options, message, score",
    [
        ((40, 0, 20, 10, 30), {}, "Error burst: 5 events in 40s (configured window 60s)", 75),
        ((0, 20, 40, 100, 101, 102), {"burst_threshold": 3}, "Error burst: 3 events in 2s (configured window 60s)", 62),
        ((0, 15, 30, 45, 61), {}, None, None),
    ],
)
def test_error_bursts(spark, at, options, message, score):
    found = [r for r in rules.detect_anomalies(events(spark, *({"at": x} for x in at)), **options).collect() if r["rule"] == "error-burst"]
    assert [(r["message"], r["score"]) for r in found] == ([(message, score)] if message else [])


def test_bursts_equal_brute_force(spark):
    pick = random.Random(1)
    given = [{"s": f"s{s}", "at": pick.choice([0.5, 1, 10800]) * pick.randint(0, 400)} for s in range(10) for _ in range(pick.randint(1, 60))]
    got = {r["source"]: (r["n"], r["span"]) for r in rules.bursts(rules.error_moments(events(spark, *given)), burst_window_seconds=7).collect()}
    for s in {g["s"] for g in given}:
        t = sorted(round(g["at"] * 1_000_000) for g in given if g["s"] == s)
        less, span = min((-sum(a <= x <= b for x in t), b - a) for k, a in enumerate(t) for b in t[k:] if b - a <= 7_000_000)
        assert got[s] == (-less, span)


def test_overrides_and_scoring(spark):
    given = events(spark, *[{"s": "noisy"}] * 3, *[{"s": "calm"}] * 3)
    found = rows(rules.detect_anomalies(given, error_threshold=5, source_overrides={"noisy": SourceThresholds(error_threshold=3)}))
    assert [f[2] for f in found] == ["Elevated error-level event count [noisy]"]
    long = events(spark, *[{"m": "x" * 50 + "\n", "l": "INFO"}] * 5)
    assert rules.detect_anomalies(long, scoring=ScoringConfig(max_finding_context=10)).first()["message"] == "Repeated message: xxxxxxx..."
    for bad in ({"error_threshold": 0}, {"repeat_threshold": 1}, {"burst_threshold": True}, {"burst_window_seconds": 1.5}):
        with pytest.raises(ValueError):
            rules.detect_anomalies(given, **bad)
    with pytest.raises(ValueError):
        ScoringConfig(medium_cutoff=80, high_cutoff=80)


def test_levels_and_sources(spark):
    given = events(spark, *({"l": level} for level in (" error ", "ＥＲＲＯＲ", "\tcritical\n", "FATAL", "x")))
    assert rules.source_totals(rules.message_counts(given)).first()["errors"] == 4
    given = events(spark, {"s": "api\tworker"}, {"s": "api  worker"}, {"s": "api worker"}, {"l": "INFO"})
    assert summary.summarize(given).first()["sources"] == {"<unknown>": 1, "api worker": 3}


def test_health_and_filters(spark):
    given = events(spark, *[{"s": "api"}] * 3, *[{"s": "api", "l": "INFO"}] * 2, *[{"s": "worker"}] * 2, *[{"s": "worker", "l": "INFO"}] * 8)
    assert [(r["source"], r["error_rate"]) for r in summary.concentrated_error_sources(given).collect()] == [("api", 0.6)]
    for bad in ({"min_errors": 0}, {"min_errors": True}, {"min_error_rate": float("nan")}, {"min_error_rate": 2}):
        with pytest.raises(ValueError):
            summary.concentrated_error_sources(given, **bad)
    text = events(spark, {"m": "ｄａｔａｂａｓｅ timeout", "s": "API"}, {"m": "data​base unavailable", "s": "api"}, {"m": "data\nbase"})
    assert filters.filter_events(text, contains="DATABASE").count() == 2
    assert filters.filter_events(text, sources=["api"]).count() == 2
    assert filters.filter_events(text, sources=["<unknown>"], levels=["error"]).count() == 1


def test_coverage(spark):
    given = events(spark, {"f": {"request_id": '"a"', "status": "1"}}, {"f": {"request_id": '"b"'}}, {})
    assert {r["field"]: r["coverage"] for r in coverage.field_coverage(given).collect()} == {"request_id": 2 / 3, "status": 1 / 3}
    drift = coverage.field_coverage(events(spark, *({"f": {"status": v}} for v in ("500", "503.0", '"unavailable"', "null")))).first()
    assert drift["type_drift"] and drift["type_drift_family_counts"] == {"number": 2, "string": 1} and drift["nulls"] == 1
    alias = coverage.field_coverage(events(spark, {"f": {"ａ": "null", "a": "1"}})).first()
    assert (alias["field"], alias["present"], alias["nulls"], alias["types"]) == ("a", 1, 0, {"null": 1, "integer": 1})
    assert coverage.field_coverage(events(spark)).count() == 0


def test_windows_and_diff(spark):
    given = events(spark, {"at": 240, "l": "INFO"}, {"at": 60}, {"at": 420, "l": "WARN"}, {})
    found = windows.build_time_windows(given, window_minutes=5).collect()
    assert [(r["start"][11:16], r["events"], r["error_events"]) for r in found] == [("10:00", 2, 1), ("10:05", 1, 0)]
    table = lambda *w: spark.createDataFrame([(k, *x) for k, x in enumerate(w)], "position long, start string, events long, error_events long")
    found, deltas = windows.diff_time_windows(table(("a", 6, 2), ("c", 2, 2)), table(("a", 9, 9), ("a", 4, 0), ("b", 1, 0)), threshold=0.2)
    assert rows(found) == [
        ("baseline-drift", "medium", "Error-rate drift in window a: 0.0% -> 33.3% (delta +33.3%, threshold 20%)", 2, 67),
        ("baseline-new-window", "low", "New window c with 2 error events has no reference baseline", 2, 50),
    ]
    assert [(r["window_start"], r["finding"]) for r in deltas.collect()] == [("a", True), ("b", False), ("c", True)]
    assert rows(windows.diff_time_windows(table(("a", 4, 4)), table(("a", 4, 0)), threshold=1)[0])[0][4] == 100
    for bad in (True, -1, float("nan"), "x"):
        with pytest.raises(windows.BaselineDiffError):
            windows.diff_time_windows(table(), table(), threshold=bad)
    for bad in (0, 1441, True, 2.0):
        with pytest.raises(ValueError):
            windows.build_time_windows(given, window_minutes=bad)


def test_novelty(spark, tmp_path):
    store = tmp_path / "known.json"
    corpus = novelty.KnownCorpus.load(store)
    assert corpus.learn(events(spark, {"m": "volume exhausted", "l": "INFO"}, {"m": " volume exhausted ", "l": "info"})) == 1
    corpus.save(store)
    again = novelty.KnownCorpus.load(store)
    assert again.entries == corpus.entries and (None, "INFO", "volume exhausted") in again
    assert again.learn(events(spark, {"m": "volume exhausted", "l": "INFO"}, {"m": "other", "s": "api"})) == 1
    assert again.entries[None, "INFO", "volume exhausted"][0] == 3
    found = rules.detect_novel_messages(events(spark, {"m": "volume exhausted", "l": "INFO"}, {"m": "queue drained", "l": "WARN"}), corpus.table(spark))
    assert rows(found) == [("novel-message", "medium", "Novel message: queue drained", 1, 75)]
    for bad in ("[]", "{", '{"version":2}', '{"messages":{}}', '{"messages":[{"level":1,"message":"x"}]}', '{"messages":[{"level":"a","message":"x","count":-1}]}'):
        store.write_text(bad)
        with pytest.raises(novelty.NoveltyError):
            novelty.KnownCorpus.load(store)


def test_before_1970(spark):
    early = events(spark, {"at": 0}).withColumn("timestamp", __import__("pyspark.sql.functions", fromlist=["f"]).timestamp_micros(__import__("pyspark.sql.functions", fromlist=["f"]).lit(-500_000)))
    assert windows.build_time_windows(early).first()["start"] == "1970-01-01T00:00:00+00:00"
    assert START + timedelta(0) == START
