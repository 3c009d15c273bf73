from quarrylog.plans.report import PipelineConfig
from quarrylog.sources.storage import shared_folder
from quarrylog.streaming.tail import GrowingFileReader, Watch, lines_end, lines_of


def test_a_scan_ends_where_the_file_ended_when_it_began(tmp_path):
    path = tmp_path / "x.log"
    path.write_bytes(b"one\ntwo\n\nlonger than most\nlast\npart")
    reader = GrowingFileReader(str(path), most=6)
    found, at = [], reader.initialOffset()
    for _ in range(3):
        before = at
        rows, at = reader.read(at)
        rows = list(rows)
        assert rows == list(reader.readBetweenOffsets(before, at))
        found.append(([r[0] for r in rows], rows[0][3]))
        with path.open("ab") as file:
            file.write(b"ial\n")
    assert found == [(["one"], 27), (["two", ""], 22), (["longer than most"], 5)]
    rows, at = reader.read(at)
    assert [(r[0], r[3]) for r in rows] == [("last", 0)] and at == {"generation": 0, "position": 31, "end": 31}
    rows, at = reader.read(at)
    assert [(r[0], r[3]) for r in rows] == [("partial", 4), ("ial", 4)] and at["end"] == 47
    # cut within a scan: what is left up to the old end isn't a line, or the file is shorter than the position
    path.write_bytes(path.read_bytes()[:39] + b"a longer line\n")
    rows, at = reader.read(at)
    assert [(r[0], r[3]) for r in rows] == [("nger line", 0)] and reader.read(at)[1] == at
    path.write_bytes(b"new\n")
    rows, at = reader.read(at)
    assert list(rows) == [("new", 1, 0, 0)] and at == {"generation": 1, "position": 4, "end": 4} and reader.read(at)[1] == at


def test_lines_end(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"a\n" + b"b" * 200_000 + b"\n" + b"c" * 200_000)
    assert [lines_end(str(path), p, e) for p, e in ((0, 400_003), (0, 200_003), (0, 200_002), (2, 200_002), (0, 0))] == [200_003, 200_003, 2, 2, 0]


def test_findings_do_not_depend_on_how_batches_cut_a_scan(spark, tmp_path):
    told = {}
    for most in (40, 1 << 20):
        path, told[most] = tmp_path / f"{most}.log", []
        path.write_text("ERROR boom\n" * 9)
        watch = Watch(spark, PipelineConfig(format="text", error_threshold=4, repeat_threshold=100, burst_threshold=100), shared_folder(spark, "watch"), lambda _, fresh, to=told[most]: to.append([(f["rule"], f["count"]) for f in fresh]))
        stream = lines_of(spark, str(path), most).writeStream.foreachBatch(watch.batch).option("checkpointLocation", f"{watch.state}/checkpoint").start()
        try:
            stream.processAllAvailable()
        finally:
            stream.stop()
        assert watch.scans == (3 if most == 40 else 1) and watch.untold is None and watch.matched_events == 9
    assert told[40] == told[1 << 20] == [[("elevated-errors", 9)]]
