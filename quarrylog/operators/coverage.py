"""Coverage of structured fields and drift of their types."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylog.functions import text


def json_type(value: Column) -> Column:
    """The coarse type of a JSON text."""
    first = F.substring(value, 1, 1)
    number = F.when(value.rlike("[.eENI]"), "number").otherwise("integer")
    return F.when(value.isNull() | (first == "n"), "null").when(first.isin("t", "f"), "boolean").when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").otherwise(number)


@text.arrow("array<string>")
def _wide_names(keys: pa.Array) -> pa.Array:
    return pa.array([None if k is None else [text.display_text(x) or text.EMPTY_FIELD for x in k] for k in keys.to_pylist()], pa.list_(pa.string()))


def names(fields: Column) -> Column:
    keys = F.map_keys(fields)
    wide = F.exists(keys, lambda k: k.rlike(r"[^\x00-\x7f]"))
    plain = F.transform(keys, lambda k: F.coalesce(F.nullif(F.trim(F.regexp_replace(k, r"[\x00-\x20\x7f]+", " ")), F.lit("")), F.lit(text.EMPTY_FIELD)))
    return F.when(wide, _wide_names(F.when(wide, keys))).otherwise(plain)


def field_coverage(events: DataFrame) -> DataFrame:
    """field, present, missing, coverage, populated, populated_rate, nulls, null_rate, types, type_drift, type_drift_families,
    type_drift_family_counts, type_drift_family_rates (null without drift).

    A name counts once for each event, and as null only if all its spellings there are null; types count each spelling. Both kinds of
    counts come from one explode and one partly summed shuffle. A row named null holds the number of events on the way.
    """
    entries = F.arrays_zip(F.col("_names").alias("name"), F.transform(F.map_values("fields"), json_type).alias("type"))
    rows = events.select(F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields")).withColumn("_names", names(F.col("fields")))
    rows = rows.select(entries.alias("e"))
    unit = "struct<name: string, type: string, present: bigint, nulls: bigint>"
    make = lambda name, type, present, nulls: F.struct(name.alias("name"), type.alias("type"), present.cast("long").alias("present"), nulls.cast("long").alias("nulls")).cast(unit)
    none = F.lit(None).cast("string")
    seen = F.transform(F.array_distinct(F.transform("e", lambda x: x["name"])), lambda n: make(n, none, F.lit(1), F.forall(F.filter("e", lambda x: x["name"] == n), lambda x: x["type"] == "null").cast("int")))
    typed = F.transform("e", lambda x: make(x["name"], x["type"], F.lit(0), F.lit(0)))
    once = F.array(make(none, none, F.lit(1), F.lit(0)))
    units = rows.select(F.explode(F.concat(once, seen, typed)).alias("u")).select("u.*")
    counts = units.groupBy("name", "type").agg(F.count("*").alias("n"), F.sum("present").alias("present"), F.sum("nulls").alias("nulls"))
    events_count = counts.where(F.col("name").isNull()).select(F.col("present").alias("events"))
    typed_rows = F.when(F.col("type").isNotNull(), F.struct(F.col("type").alias("key"), F.col("n").alias("value")))
    per = counts.where(F.col("name").isNotNull()).groupBy(F.col("name").alias("field")).agg(
        F.sum("present").alias("present"), F.sum("nulls").alias("nulls"), F.map_from_entries(F.array_sort(F.collect_list(typed_rows))).alias("types")
    )
    per = per.withColumn("_", F.lit(1)).join(events_count.withColumn("_", F.lit(1)), "_")  # a join with one row
    family = lambda k: F.when(k.isin("integer", "number"), "number").otherwise(k)
    known = F.filter(F.map_entries("types"), lambda x: x["key"] != "null")
    families = F.array_sort(F.array_distinct(F.transform(known, lambda x: family(x["key"]))))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x["value"])
    by_family = F.map_from_arrays(families, F.transform(families, lambda f: total(F.filter(known, lambda x: family(x["key"]) == f))))
    drift = F.size(families) > 1
    populated = F.col("present") - F.col("nulls")
    return per.select(
        "field", "present", (F.col("events") - F.col("present")).alias("missing"), (F.col("present") / F.col("events")).alias("coverage"),
        populated.alias("populated"), (populated / F.col("events")).alias("populated_rate"), "nulls", (F.col("nulls") / F.col("present")).alias("null_rate"),
        "types", drift.alias("type_drift"), F.when(drift, families).alias("type_drift_families"), F.when(drift, by_family).alias("type_drift_family_counts"),
        F.when(drift, F.transform_values(by_family, lambda _, v: v / total(known))).alias("type_drift_family_rates"),
    ).orderBy("field")


