"""The corpus of known messages: reading, merging, writing.

A corpus is a DataFrame (source, level, message, count, first_seen) of normalised keys. The JSON file of the tool is read and written on the
driver, a record at a time: the keys lie in a temporary database on its disk, so that its memory doesn't grow with them. Merging is a join.
"""

from __future__ import annotations

import sqlite3
import weakref
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from json.encoder import encode_basestring_ascii as quoted
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions import text
from quarrylog.operators.rules import message_counts
from quarrylog.sources.json_reader import JsonReader
from quarrylog.sources.storage import shared_folder

VERSION = 1
SCHEMA = "source string, level string, message string, count long, first_seen string"
NAMES = ("source", "level", "message", "count", "first_seen")
_ARROW = pa.schema([(name, pa.int64() if name == "count" else pa.string()) for name in NAMES])
#: Characters and rows of the entries that go to the cluster at once.
BATCH, ROWS = 16 << 20, 200_000


class NoveltyError(ValueError):
    """A corpus file that can't be read or written."""


def corpus_key(source: str | None, level: str, message: str) -> tuple[str | None, str, str]:
    return text.rule_source_text(source), text.level_text(level), text.rule_message_text(message)


class _Entries:
    """Entries in the order of their keys, in a temporary database on disk that goes with the object."""

    def __init__(self, rows: Iterable[tuple] = ()):
        self.db = sqlite3.connect("", check_same_thread=False)  # a file without a name, in TMPDIR
        weakref.finalize(self, self.db.close)
        for setting in ("journal_mode = OFF", "synchronous = OFF", "temp_store = FILE", "cache_size = -16384"):
            self.db.execute(f"PRAGMA {setting}")
        # `named` is 0 where there is no source
        self.db.execute("CREATE TABLE e (source TEXT, level TEXT, message TEXT, named INTEGER, count INTEGER, first_seen TEXT, PRIMARY KEY (source, level, message, named)) WITHOUT ROWID")
        self.put(rows)

    def put(self, rows: Iterable[tuple]) -> None:
        """Adds rows of NAMES; the later of equal keys stays."""
        self.db.executemany("INSERT OR REPLACE INTO e VALUES (?, ?, ?, ?, ?, ?)", ((s or "", level, message, s is not None, n, seen) for s, level, message, n, seen in rows))
        self.db.commit()

    def clear(self) -> None:
        self.db.execute("DELETE FROM e")
        self.db.commit()

    def __len__(self) -> int:
        return self.db.execute("SELECT count(*) FROM e").fetchone()[0]

    def __contains__(self, key: tuple[str | None, str, str]) -> bool:
        source, level, message = key
        found = self.db.execute("SELECT 1 FROM e WHERE source = ? AND level = ? AND message = ? AND named = ?", (source or "", level, message, source is not None))
        return found.fetchone() is not None

    def __iter__(self) -> Iterator[tuple]:
        return self.db.execute("SELECT iif(named, source, NULL), level, message, count, first_seen FROM e ORDER BY source, level, message, named")

    def tables(self) -> Iterator[pa.Table]:
        """All rows, one table at least."""
        some, size = [], 0
        table = lambda: pa.table([pa.array(c, f.type) for c, f in zip(zip(*some) if some else [()] * len(NAMES), _ARROW, strict=True)], schema=_ARROW)
        for row in self:
            some.append(row)
            size += len(row[0] or "") + len(row[2])
            if size >= BATCH or len(some) >= ROWS:
                yield table()
                some, size = [], 0
        yield table()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["packed"])


def _local_rows(table: DataFrame) -> Iterator[tuple]:
    """The rows of a table, a partition at a time."""
    for (packed,) in table.mapInArrow(_packed, "packed binary").toLocalIterator():
        for b in pa.ipc.open_stream(packed):
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


class KnownCorpus:
    """Known message keys with their counts and when they were first seen."""

    def __init__(self, entries: dict[tuple[str | None, str, str], tuple[int, str]] | None = None):
        self._entries = _Entries((*k, *v) for k, v in (entries or {}).items())

    @classmethod
    def load(cls, path: str | Path) -> KnownCorpus:
        """The corpus in a file; a missing file is an empty corpus."""
        corpus = cls()
        fail = lambda why: NoveltyError(f"novelty store {path}: {why}")
        clean = lambda s: s.encode("utf-8", "replace").decode()  # noqa: E731  lone surrogates, as in parsed lines

        def rows(records: Iterator[object]) -> Iterator[tuple]:
            for r in records:
                if not isinstance(r, dict):
                    raise fail("message records must be objects")
                source, level, message, count = r.get("source"), r.get("level"), r.get("message"), r.get("count", 1)
                if not isinstance(source, str | None):
                    raise fail("message records need a string source")
                if not isinstance(level, str) or not isinstance(message, str):
                    raise fail("message records need string level and message")
                if type(count) is not int or not 0 <= count < 1 << 63:
                    raise fail("message records need a non-negative integer count of 64 bits")
                yield *corpus_key(clean(source) if source else None, clean(level), clean(message)), count, clean(str(r.get("first_seen", "")))

        try:
            with open(path, encoding="utf-8") as file:
                reader = JsonReader(file)
                if reader.peek() != "{":
                    raise fail("must hold a JSON object")
                for name in reader.members():
                    if name == "messages":
                        if reader.peek() != "[":
                            raise fail("messages must be a list")
                        corpus._entries.clear()
                        corpus._entries.put(rows(reader.items()))
                    elif (value := reader.value()) != VERSION and name == "version":
                        raise fail(f"unsupported version {value!r}")
                reader.close()
        except FileNotFoundError:
            return cls()
        except OSError as e:
            raise fail(f"cannot be read: {e}") from e
        except NoveltyError:
            raise
        except ValueError as e:
            raise fail(f"invalid JSON: {e}") from e
        return corpus

    @classmethod
    def of(cls, table: DataFrame) -> KnownCorpus:
        corpus = cls()
        corpus._entries.put(_local_rows(table.select(*NAMES).orderBy(*NAMES[:3])))  # in the order of the database
        return corpus

    @property
    def entries(self) -> dict[tuple[str | None, str, str], tuple[int, str]]:
        """All of them as a dictionary, for a corpus that the driver's memory holds."""
        return {r[:3]: r[3:] for r in self._entries}

    def __contains__(self, key: tuple[str | None, str, str]) -> bool:
        return key in self._entries

    def __len__(self) -> int:
        return len(self._entries)

    def keys(self) -> frozenset:
        return frozenset(self.entries)

    def table(self, spark: SparkSession) -> DataFrame:
        """The entries as a table in the shared folder."""
        path = shared_folder(spark, "known-messages")
        for some in self._entries.tables():
            spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return spark.read.schema(SCHEMA).parquet(path)

    def learn(self, events: DataFrame, *, observed_at: datetime | None = None) -> int:
        """Adds the events' messages; gives the number of new keys."""
        return self.learn_counts(message_counts(events), observed_at=observed_at)

    def learn_counts(self, counts: DataFrame, *, observed_at: datetime | None = None) -> int:
        """learn for a table of message_counts. The merge is a join on the cluster."""
        before = len(self)
        merged = merge(self.table(counts.sparkSession), counts, observed_at=observed_at)
        self._entries = KnownCorpus.of(merged)._entries
        return len(self) - before

    def to_dict(self) -> dict:
        """What save writes, whole."""
        return {"version": VERSION, "messages": [dict(zip(NAMES, r, strict=True)) for r in self._entries]}

    def _pieces(self) -> Iterator[str]:
        """json.dumps(self.to_dict(), indent=2, sort_keys=True), piece by piece."""
        value = lambda s: "null" if s is None else quoted(s)
        yield '{\n  "messages": ['
        comma = ""
        for source, level, message, count, seen in self._entries:
            yield f'{comma}\n    {{\n      "count": {count},\n      "first_seen": {value(seen)},\n      "level": {quoted(level)},\n      "message": {quoted(message)},\n      "source": {value(source)}\n    }}'
            comma = ","
        yield ("\n  " if comma else "") + f'],\n  "version": {VERSION}\n}}'

    def save(self, path: str | Path) -> None:
        try:
            with open(path, "w", encoding="utf-8") as file:
                file.writelines(self._pieces())
                file.write("\n")
        except OSError as e:
            raise NoveltyError(f"cannot write novelty store {path}: {e}") from e


def merge(corpus: DataFrame, counts: DataFrame, *, observed_at: datetime | None = None) -> DataFrame:
    """corpus with the counts of message_counts added: source, level, message, count, first_seen, is_new."""
    moment = (observed_at or datetime.now(UTC)).isoformat()
    new = counts.where(F.col("key") != "").select(F.col("source").alias("_s"), F.col("level").alias("_l"), F.col("key").alias("_m"), "n")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("level") == F.col("_l")) & (F.col("message") == F.col("_m"))
    unknown = F.col("level").isNull()
    return corpus.join(new, same, "full_outer").select(
        F.when(unknown, F.col("_s")).otherwise(F.col("source")).alias("source"), F.coalesce("level", "_l").alias("level"), F.coalesce("message", "_m").alias("message"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("count"), F.when(unknown, moment).otherwise(F.col("first_seen")).alias("first_seen"), unknown.alias("is_new"),
    )
