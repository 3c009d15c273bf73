"""A growing file as a stream, and rules over all that it has held.

The source reads complete lines only. Its offset is {generation, position, end}: the position is that of the byte after the last newline, so a
batch can be read again; a file that became shorter starts a new generation at 0, while what was counted stays counted. A scan takes all complete
lines that the file has when it begins, up to `end`, in as many batches as they need; rules are told once, at its end, so that what
is found doesn't depend on how the batches cut it.

Each batch is parsed, and merged into two tables of state: message counts, and errors per moment. Rules read those, never old lines. A
version of the state is written for each batch, and named by it, so that a batch that is run again replaces its own version.
"""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quarrylog.operators import filters, rules
from quarrylog.plans.report import PipelineConfig, rows_of
from quarrylog.sources.reader import check_format, parse_lines, spread

FORMAT = "growing_file"


#: Bytes that a batch takes from the file, about; what is left comes with the next one.
BATCH = 32 << 20


def complete_lines(path: str, position: int, end: int | None = None, most: int | None = None) -> tuple[list[str], int]:
    """The lines from position to the last newline (before end, and within `most` bytes, or in the first line), and the position after it."""
    with open(path, "rb") as file:
        file.seek(position)
        left = sys.maxsize if end is None else end - position
        data = file.read(-1 if end is most is None else left if most is None else min(most, left))
        while most is not None and b"\n" not in data and (more := file.read(min(most, left - len(data)))):
            data += more
    data = data[: data.rfind(b"\n") + 1]
    return data.decode("utf-8", "replace").splitlines(), position + len(data)


def lines_end(path: str, position: int, end: int) -> int:
    """The position after the last newline between position and end; position, if there is none."""
    with open(path, "rb") as file:
        while end > position:
            at = max(position, end - (1 << 16))
            file.seek(at)
            if (found := file.read(end - at).rfind(b"\n")) >= 0:
                return at + found + 1
            end = at
    return position


class GrowingFileReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int = BATCH):
        self.path, self.most = path, most

    def initialOffset(self) -> dict:
        return {"generation": 0, "position": 0, "end": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            size = os.stat(self.path).st_size
            if size < start["position"]:
                start = {"generation": start["generation"] + 1, "position": 0, "end": 0}
            position, end, lines = start["position"], start["end"], []
            if position < end <= size:
                lines, after = complete_lines(self.path, position, end, self.most)
            if not lines:  # a new scan; also where a file that was cut has no line up to the old end
                end = lines_end(self.path, position, size)
                lines, after = complete_lines(self.path, position, end, self.most)
        except OSError:  # the file is away for a while, as when it is rotated
            return iter(()), start
        if not lines:
            return iter(()), start
        return self._rows(lines, start, end - after), {**start, "position": after, "end": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        position = start["position"] if start["generation"] == end["generation"] else 0
        lines, _ = complete_lines(self.path, position, end["position"])
        return self._rows(lines, {**end, "position": position}, end["end"] - end["position"])

    @staticmethod
    def _rows(lines: list[str], start: dict, left: int) -> Iterator[tuple]:
        return iter([(x, start["generation"], start["position"] + k, left) for k, x in enumerate(lines)])


class GrowingFile(DataSource):
    """spark.readStream.format("growing_file").option("path", ...): raw, generation, place (which orders a file's lines), left (bytes of the scan
    after this batch). Option most: about how many bytes a batch takes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "raw string, generation long, place long, left long"

    def simpleStreamReader(self, schema) -> GrowingFileReader:
        return GrowingFileReader(self.options["path"], int(self.options["most"]))


def lines_of(spark: SparkSession, path: str, most: int = BATCH) -> DataFrame:
    spark.dataSource.register(GrowingFile)
    lines = spark.readStream.format(FORMAT).option("path", path).option("most", most).load()
    return lines.select(F.lit(path).alias("provenance"), "raw", F.struct("generation", "place").alias("ord"), "left")


class Watch:
    """Rules over a stream of lines (provenance, raw, ord, and left, if scans have several batches). `emit` gets the number of a scan's last
    batch and the scan's new findings, if there are any."""

    def __init__(self, spark: SparkSession, config: PipelineConfig, state: str, emit: Callable[[int, list[dict]], None], *, known: DataFrame | None = None, max_parse_errors: int = 0):
        check_format(config.format)
        rules.check_thresholds(**config.thresholds())
        self.spark, self.config, self.state, self.emit, self.known, self.max_parse_errors = spark, config, state, emit, known, max_parse_errors
        self.input_events = self.matched_events = self.parse_errors = self.scans = 0
        self.seen: set[tuple[str, str]] = set()
        self.over_budget = False
        self.untold: tuple[DataFrame, DataFrame] | None = None  # counts and moments of a scan that isn't at its end

    def _merged(self, name: str, batch: DataFrame, version: int, keys: list[str], *aggregates) -> DataFrame:
        old = f"{self.state}/{name}-{self.last}"
        table = batch if self.last is None else self.spark.read.schema(batch.schema).parquet(old).unionByName(batch)
        path = f"{self.state}/{name}-{version}"
        table.groupBy(*keys).agg(*aggregates).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    last: int | None = None

    def batch(self, lines: DataFrame, number: int) -> None:
        config = self.config
        left = lines.select("left").first() if "left" in lines.columns else None
        parsed = parse_lines(spread(lines), config.format).persist()  # a batch comes as one partition
        try:
            got = parsed.agg(F.count("*"), F.count("parse_error")).first()
            events = filters.filter_events(parsed.where(F.col("parse_error").isNull()), levels=config.levels, contains=config.contains, sources=config.sources)
            self.input_events, self.parse_errors = self.input_events + got[0], self.parse_errors + got[1]
            first = F.struct(F.lit(number).cast("long").alias("batch"), F.col("ord.generation"), F.col("ord.place"))
            new = rules.message_counts(events.withColumn("ord", first))
            counts = self._merged("counts", new, number, ["source", "level", "key"], F.sum("n").alias("n"), F.min_by("evidence", "ord").alias("evidence"), F.min("ord").alias("ord"))
            moments = self._merged("moments", rules.error_moments(events), number, ["source", "t"], F.sum("n").alias("n"))
            self.last = number
            self.matched_events += events.count()
        finally:
            parsed.unpersist()
        self.scans += 1
        if self.parse_errors > self.max_parse_errors:
            self.over_budget = True
            return
        self.untold = counts, moments
        if not (left and left[0]):
            self.tell(number)

    def tell(self, number: int) -> None:
        """Emits what is new since the last time."""
        config, (counts, moments), self.untold = self.config, self.untold, None
        found = rules.findings_of(counts, moments, **config.thresholds(), scoring=config.scoring, source_overrides=config.source_overrides, known=self.known)
        fresh = [f for f in rows_of(rules.ordered(found)) if (f["rule"], f["message"]) not in self.seen]
        self.seen.update((f["rule"], f["message"]) for f in fresh)
        if fresh:
            self.emit(number, fresh)

    def run(self, lines: DataFrame, *, interval: float = 1.0, timeout: float | None = None) -> None:
        """Until the timeout, the parse budget or an interrupt; what is in the file at the timeout is still read."""
        query = lines.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.state}/checkpoint").trigger(processingTime=f"{max(1, round(interval * 1000))} milliseconds").start()
        end = None if timeout is None else time.monotonic() + timeout
        try:
            while not self.over_budget:
                left = 0.1 if end is None else min(0.1, end - time.monotonic())
                if left < 0.002:  # the wait is in whole milliseconds
                    query.processAllAvailable()
                    break
                if query.awaitTermination(left):
                    break
        finally:
            query.stop()
        if self.untold and not self.over_budget:  # the file was cut within a scan
            self.tell(self.last)
