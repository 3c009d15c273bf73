from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from quarrylog.sources.reader import parse_lines

START = datetime(2026, 9, 15, 10, tzinfo=UTC)
EVENT = "message string, level string, timestamp timestamp, source string, fields map<string,string>, ord long"


def events(spark, *rows):
    """Events from dictionaries: m(essage), l(evel), at (seconds after START), s(ource), f(ields)."""
    make = lambda k, r: (r.get("m", f"message {k}"), r.get("l", "ERROR"), None if "at" not in r else START + timedelta(seconds=r["at"]), r.get("s"), r.get("f", {}), k)
    return spark.createDataFrame([make(k, r) for k, r in enumerate(rows)], EVENT)


def parsed(spark, lines, format="auto", provenance="file"):
    table = spark.createDataFrame([(x, provenance, k) for k, x in enumerate(lines)], "raw string, provenance string, ord long")
    return parse_lines(table, format).withColumn("micros", F.unix_micros("timestamp")).orderBy("ord").collect()
