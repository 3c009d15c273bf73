import gzip
import io
import json
import threading
import time

import pytest

from quarrylog.cli import build_parser, main
from quarrylog.plans import policy, sinks
from quarrylog.streaming.tail import complete_lines

DEMO = [{"timestamp": f"2026-09-15T18:00:{s:02}Z", "level": "INFO", "source": "api", "message": "request completed"} for s in (0, 10)] + [
    {"timestamp": f"2026-09-15T18:01:{s:02}Z", "level": "ERROR", "source": "api", "message": "replica unreachable"} for s in range(0, 25, 5)
]


@pytest.fixture
def demo(tmp_path):
    path = tmp_path / "demo.jsonl"
    path.write_text("".join(json.dumps(x) + "\n" for x in DEMO))
    return path


def run(capsys, *args):
    code = main(["analyze", *map(str, args)])
    out = capsys.readouterr()
    return code, out.out, out.err


def test_demo(spark, capsys, demo):
    code, out, _ = run(capsys, demo, "--format", "json", "--window-minutes", 1, "--json")
    report = json.loads(out)
    assert code == 0 and (report["input_events"], report["matched_events"], report["parse_errors"]) == (7, 7, 0)
    assert [(h["source"], h["events"], h["error_events"]) for h in report["source_health"]] == [("api", 7, 5)]
    assert report["time_baseline"]["timestamped_events"] == 7
    assert {"elevated-errors", "repeated-message", "error-burst"} <= {f["rule"] for f in report["findings"]}
    assert run(capsys, demo, "--fail-on-severity", "low")[0] == 3
    code, out, _ = run(capsys, demo, "--csv", "--level", "error", "--window-minutes", 1)
    assert code == 0 and out.startswith("record_type,name,value,severity,score,message\r\n") and "\r\nsource,api,5," in out
    code, out, _ = run(capsys, demo, "--contains", "UNREACHABLE")
    assert "Input: 7 | Matched: 5 | Parse errors: 0" in out


def test_errors_and_exit_codes(spark, capsys, tmp_path, demo, monkeypatch):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"level":"INFO"}\n\n{bad}\n')
    assert run(capsys, bad, "--format", "json")[0] == 2
    assert run(capsys, bad, "--format", "json", "--max-parse-errors", 1)[0] == 0
    code, out, err = run(capsys, tmp_path / "missing.log")
    assert code == 1 and out == "" and "quarrylog: ERROR:" in err
    assert run(capsys, demo, "--policy", "x")[0] == 1 and run(capsys, demo, "--novelty-learn")[0] == 1 and run(capsys, demo, "--baseline-diff", demo)[0] == 1
    for options in (["--error-threshold", "0"], ["--repeat-threshold", "1"], ["--window-minutes", "1441"], ["--baseline-diff-threshold", "nan"], ["--watch-interval", "0"], ["--json", "--csv"]):
        with pytest.raises(SystemExit) as e:
            build_parser().parse_args(["analyze", "x", *options])
        assert e.value.code == 2
    for options in (["--csv"], ["--window-minutes", "5"], ["--novelty-learn"]):
        with pytest.raises(SystemExit):
            main(["analyze", str(demo), "--follow", *options])
    monkeypatch.setattr("sys.stdin", io.StringIO("ERROR x\nINFO y\n"))
    code, out, _ = run(capsys, "-", "--json")
    assert code == 0 and json.loads(out)["source"] == "<stdin>"


@pytest.mark.parametrize("name", ["a.log.gz", "A.LOG.GZ"])
def test_gzip(spark, capsys, tmp_path, name):
    path = tmp_path / name
    path.write_bytes(gzip.compress(b"ERROR one\r\nINFO two\n"))
    code, out, _ = run(capsys, path, "--json")
    assert code == 0 and json.loads(out)["levels"] == {"ERROR": 1, "INFO": 1}


def test_policy_novelty_and_baseline(spark, capsys, tmp_path, demo):
    config, store, saved = tmp_path / "p.toml", tmp_path / "known.json", tmp_path / "ref.json"
    config.write_text('[policy.strict]\nerror_threshold = 2\n[policy.strict.sources."api"]\nrepeat_threshold = 100\n')
    code, out, _ = run(capsys, demo, "--config", config, "--json", "--window-minutes", 1)
    report = json.loads(out)
    assert report["policy"] == "strict" and report["source_overrides"] == {"api": {"repeat_threshold": 100}} and "repeated-message" not in {f["rule"] for f in report["findings"]}
    saved.write_text(json.dumps({"windows": [{"start": "2026-09-15T18:01:00+00:00", "events": 4, "error_events": 0}]}))
    report = json.loads(run(capsys, demo, "--json", "--window-minutes", 1, "--baseline-diff", saved)[1])
    assert report["baseline_diff"]["compared_windows"] == 2 and report["findings"][-1]["score"] == 100
    report = json.loads(run(capsys, demo, "--json", "--novelty-store", store, "--novelty-learn")[1])
    assert report["novelty"] == {"store": str(store), "mode": "learn", "known_messages": 2, "learned_messages": 2}
    report = json.loads(run(capsys, demo, "--json", "--novelty-store", store)[1])
    assert report["novelty"]["mode"] == "detect" and "novel-message" not in {f["rule"] for f in report["findings"]}


@pytest.mark.parametrize("text", ["", "[x]\n", "[policy.a]\nwhat = 1\n", "[policy.a]\nerror_threshold = true\n", '[policy.a.sources." "]\n', "[policy.a.scoring]\nhigh_cutoff = 10\n", "[policy.a]\n[policy.b]\n"])
def test_bad_policies(tmp_path, text):
    path = tmp_path / "p.toml"
    path.write_text(text)
    with pytest.raises(policy.ConfigError):
        policy.resolve_policy(policy.load_policies(path))


def test_csv_cells():
    assert [sinks.csv_cell(x) for x in ("=1", " +x", "a\nb", "a\x01", "​", 3)] == ["'=1", "' +x", "a\\nb", "a\\x01", "\\u200b", 3]
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            sinks.csv_cell(bad)
        with pytest.raises(ValueError):
            sinks.report_to_json({"x": bad})


def test_complete_lines(tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"one\ntwo\npart")
    assert complete_lines(str(path), 0) == (["one", "two"], 8)
    path.write_bytes(b"one\ntwo\npartial\n")
    assert complete_lines(str(path), 8) == (["partial"], 16)


def test_follow(spark, capsys, tmp_path):
    path = tmp_path / "app.log"
    path.write_text("ERROR boom\n" * 3)

    def write():
        time.sleep(2)
        with path.open("a") as file:
            file.write("ERROR boom\n" * 3 + "INFO par")
        time.sleep(2)
        with path.open("a") as file:
            file.write("tial\n")

    writer = threading.Thread(target=write)
    writer.start()
    code, out, err = run(capsys, path, "--follow", "--watch-interval", 0.2, "--watch-timeout", 9, "--json", "--fail-on-severity", "medium")
    writer.join()
    scans = [json.loads(x) for x in out.splitlines()]
    assert code == 3 and sorted(f["rule"] for s in scans for f in s["new_findings"]) == ["elevated-errors", "repeated-message"]
    assert "7 lines in" in err


def test_follow_budget(spark, capsys, tmp_path):
    path = tmp_path / "app.jsonl"
    path.write_text('{"level":"INFO"}\n{bad}\n')
    code, _, err = run(capsys, path, "--follow", "--format", "json", "--watch-interval", 0.2, "--watch-timeout", 20)
    assert code == 2 and "budget exceeded" in err
