import io
import json
import tracemalloc

import pytest

from quarrylog.operators import novelty
from quarrylog.sources.json_reader import JsonReader

RECORDS = [
    {"source": None, "level": "INFO", "message": 'a "quoted" é\n  \U0001f600', "count": 2, "first_seen": "x"},
    {"source": "", "level": " info ", "message": "plain", "count": 0},
    {"source": "api", "level": "WARN", "message": "z" * 5000, "count": 12345678901, "first_seen": 7, "more": {"a": [1.5e-3, True, None, "]}"]}},
]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 3])
def test_json_reader_equals_json(chunk, indent):
    data = {"n": 12.5e-1, "messages": RECORDS, "empty": [], "object": {}, "t": True, "-": -17}
    reader, found = JsonReader(io.StringIO(f" {json.dumps(data, indent=indent)}\n"), chunk), {}
    for name in reader.members():
        found[name] = list(reader.items()) if name in ("messages", "empty") else reader.value()
    reader.close()
    assert found == data


@pytest.mark.parametrize("bad", ["", " ", "[]", '"x"', "{", '{"messages":[', '{"messages":[{}', '{"messages":[]', '{"messages":[],}', '{"messages":[]}x', '{"messages":[1]}', '{"a" 1}', "{a:1}", '{"messages":[{"level":"a","message":"x"},]}', '{"messages":[{"level":"a","message":"x","count":9223372036854775808}]}', '{"messages":[],"version":[1]}', '{"a":tru}', '{"a":"'])
def test_bad_files(tmp_path, bad):
    (tmp_path / "x").write_text(bad)
    with pytest.raises(novelty.NoveltyError):
        novelty.KnownCorpus.load(tmp_path / "x")


def test_later_records_of_a_key_stay_and_files_are_as_before(spark, tmp_path):
    path, again = tmp_path / "known.json", tmp_path / "again.json"
    path.write_text(json.dumps({"messages": [*RECORDS, {"source": " ", "level": "INFO", "message": "plain ", "count": 5, "first_seen": "later"}]}))
    corpus = novelty.KnownCorpus.load(path)
    assert corpus.entries[None, "INFO", "plain"] == (5, "later") and len(corpus) == 3 and ("api", "WARN", "x") not in corpus
    corpus.save(again)
    rows = sorted(corpus.entries.items(), key=lambda kv: (kv[0][0] or "", kv[0][1], kv[0][2]))
    records = [dict(zip(novelty.NAMES, (*k, *v), strict=True)) for k, v in rows]
    assert again.read_text() == json.dumps({"version": 1, "messages": records}, indent=2, sort_keys=True) + "\n"
    assert novelty.KnownCorpus.of(corpus.table(spark)).entries == novelty.KnownCorpus.load(again).entries == corpus.entries
    empty = novelty.KnownCorpus()
    empty.save(again)
    assert again.read_text() == json.dumps({"version": 1, "messages": []}, indent=2) .replace('"version": 1,\n  "messages": []', '"messages": [],\n  "version": 1') + "\n"
    assert empty.table(spark).count() == len(novelty.KnownCorpus.load(again)) == 0


def test_memory_does_not_grow_with_the_corpus(spark, tmp_path):
    """Learned, saved, read and made a table again, the keys stay out of the driver's memory."""
    path = tmp_path / "known.json"
    given = spark.range(60_000).selectExpr("concat('source-', id) AS source", "'INFO' AS level", "concat('message number ', id) AS key", "2L AS n")
    corpus = novelty.KnownCorpus()
    tracemalloc.start()
    try:
        assert corpus.learn_counts(given) == 60_000
        corpus.save(path)
        corpus = novelty.KnownCorpus.load(path)
        after_load = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(corpus) == 60_000 and after_load[1] < 10 << 20
    table = corpus.table(spark)
    assert table.count() == 60_000 and table.where("count != 2 OR level != 'INFO'").count() == 0
