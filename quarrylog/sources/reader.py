"""Log files to event rows.

read_lines gives provenance, raw and ord (file, block, row: the input's order, for first-seen evidence); parse_lines adds the parsed event. One
scan serves both parsers: a line that the JVM expressions cover reaches the Python parser as a null.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylog.functions.text import arrow, event_source
from quarrylog.sources import native
from quarrylog.sources.exact import PARSERS
from quarrylog.sources.storage import shared_folder

FORMATS = ("auto", "json", "text", "rfc5424")
#: What str.strip() takes for blank.
_SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BLANK = f"^[{_SPACE}]*$"
_PARSED = "struct<error: string, message: string, level: string, micros: bigint, source: string, fields: map<string, string>>"


def check_format(format: str) -> None:
    if format not in FORMATS:
        raise ValueError("format must be one of: auto, json, text, rfc5424")


def read_lines(spark: SparkSession, path: str | list[str], provenance: str | None = None) -> DataFrame:
    """Lines of text files; `.gz` in any case is decompressed, '-' is standard input. Bytes that aren't UTF-8 become U+FFFD."""
    if path == "-":
        path, provenance = _spooled(spark), provenance or "<stdin>"
    name = path if isinstance(path, str) else ""
    if name.lower().endswith(".gz") and not name.endswith(".gz"):
        lines = _odd_gzip(spark, name)
    else:
        lines = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return lines.select(
        F.lit(provenance).alias("provenance") if provenance is not None else F.col("file").alias("provenance"),
        F.make_valid_utf8("raw").alias("raw"),
        F.struct("file", "block", F.monotonically_increasing_id().alias("row")).alias("ord"),
    )


def _spooled(spark: SparkSession) -> str:
    """Standard input as a file that the executors see."""
    import pyarrow.fs

    fs, folder = pyarrow.fs.FileSystem.from_uri(shared_folder(spark, "stdin"))
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/stdin.log") as spool:
        for line in sys.stdin:
            spool.write(line.encode("utf-8", "replace"))
    return ("file://" if fs.type_name == "local" else "") + f"{folder}/stdin.log"


def _odd_gzip(spark: SparkSession, path: str) -> DataFrame:
    """A gzip file whose suffix isn't in lower case, which the text reader takes for plain text. A gzip file has one reader in any case; it
    unpacks a piece at a time. Where Arrow doesn't know the file system, the file comes as one value, which Spark bounds at 2 GB."""
    import gzip
    import io

    import pyarrow.fs

    def rows(name: str, file) -> Iterator[pa.RecordBatch]:
        # universal newlines, as the text reader has them
        text = io.TextIOWrapper(gzip.GzipFile(fileobj=file), encoding="utf-8", errors="replace", newline=None)
        while some := [line.removesuffix("\n") for line in itertools.islice(text, 10_000)]:
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([name] * len(some)), pa.array([0] * len(some), pa.int64())], ["raw", "file", "block"])

    def by_path(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(name)
                with fs.open_input_stream(at) as file:
                    yield from rows(name, file)

    def by_content(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from rows(name, io.BytesIO(data))

    files = spark.read.format("binaryFile").load(path)
    known = path.partition(":")[0] in ("file", "hdfs", "s3", "gs") or ":" not in path
    return (files.select("path") if known else files.select("path", "content")).mapInArrow(by_path if known else by_content, "raw string, file string, block long")


def _python(format: str):
    parse = PARSERS[format]

    def one(raw: str | None, provenance: str | None) -> dict | None:
        if raw is None:
            return None
        try:
            message, level, micros, source, fields = parse(raw, provenance)
        except Exception as e:  # any failure of a parser is a counted error, not the end of the job
            return {"error": f"{type(e).__name__}: {e}"}
        clean = lambda s: None if s is None else s.encode("utf-8", "replace").decode()  # noqa: E731  lone surrogates
        return {"message": clean(message), "level": level, "micros": micros, "source": clean(source), "fields": [(clean(k), clean(v)) for k, v in fields.items()]}

    @arrow(_PARSED)
    def run(raw: pa.Array, provenance: pa.Array) -> pa.Array:
        kind = pa.struct([("error", pa.string()), ("message", pa.string()), ("level", pa.string()), ("micros", pa.int64()), ("source", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
        return pa.array([one(r, p) for r, p in zip(raw.to_pylist(), provenance.to_pylist(), strict=True)], kind)

    return run


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files can't be split into enough parts, as gzip files and small ones can't."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def parse_lines(lines: DataFrame, format: str = "auto") -> DataFrame:
    """lines (provenance, raw, ...) without blank ones, with parse_error, message, level, timestamp, source, fields."""
    check_format(format)
    raw, provenance = F.col("raw"), F.col("provenance")
    lines = lines.where(~raw.rlike(_BLANK))
    if format == "rfc5424":
        parsed = native.with_rfc5424(lines, "_e")
    else:
        if format == "json":
            parsed = native.with_json(lines, "_f")
        elif format == "text":
            parsed = native.with_text(lines, "_f")
        else:
            # a line that begins with a brace is text only if it isn't JSON, which Python decides
            brace = raw.rlike(f"^[{_SPACE}]*\\{{")
            parsed = native.with_text(native.with_json(lines, "_j"), "_t").withColumn("_f", F.when(brace, F.col("_j")).otherwise(F.col("_t")))
        parsed = parsed.withColumn("_p", _python(format)(F.when(F.col("_f").isNull(), raw), provenance))
        slow = F.struct(F.col("_p.error").alias("error"), F.col("_p.message").alias("message"), F.col("_p.level").alias("level"), F.timestamp_micros("_p.micros").alias("timestamp"), F.col("_p.source").alias("source"), F.col("_p.fields").alias("fields"))
        parsed = parsed.withColumn("_e", F.coalesce("_f", slow))
    # a filter on a parsed column would be pushed below the parser, and repeat it there; it stops at a value that isn't deterministic
    parsed = parsed.withColumn("_row", F.monotonically_increasing_id())
    error = F.when(F.col("_row") >= 0, F.col("_e.error"))
    kept = [c for c in lines.columns if c not in ("message", "level", "timestamp", "source", "fields", "parse_error")]
    return parsed.select(
        *kept, error.alias("parse_error"), F.col("_e.message").alias("message"), F.col("_e.level").alias("level"),
        F.col("_e.timestamp").alias("timestamp"), event_source(F.col("_e.source")).alias("source"), F.col("_e.fields").alias("fields"),
    )


def read_logs(spark: SparkSession, path: str | list[str], format: str = "auto", provenance: str | None = None) -> DataFrame:
    """Parsed rows of log files, failed lines among them (parse_error set)."""
    return parse_lines(spread(read_lines(spark, path, provenance)), format)


def events_of(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("parse_error").isNull()).drop("parse_error")
