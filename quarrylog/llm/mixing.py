"""Mixing sources to target weights.

Tokens (words) are summed per source, each source's target gives a repetition rate, and a document is emitted
floor(rate) times plus one copy drawn by a Bernoulli trial whose probability is the rate's fraction. The draw is a hash
of seed and doc_id, so reruns agree and a lost executor's rows come back the same. Where rows share a doc_id, or have none, a hash of the text and
the row's place in the table are hashed, too, so that each row has a draw of its own.

Only (source, size) sums are shuffled, partially summed before the shuffle, so a source with a third of all rows
costs one row per task. The rates (a row per source) are written to the shared folder and joined; the planner
broadcasts them only below its own size threshold, else the join is sort-merge, where AQE splits a hot source.

Nulls: a null text has size 0; null is a source of its own, ordered last; null doc_ids count as one id.
Repeated rows are drawn one by one. Empty tables give empty results. Other columns pass through; columns
named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.llm.common import Carried, session, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the draw; 13 digits are exact in a double.
DIGITS = 13
ADDED = ("size", "source_size", "target", "copies")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source: source, source_size, target.

    The reshared excess has a closed form: targets are min(w * level, cap * size), where level is where they sum to
    the share. In the order of cap * size / w, the first source whose ratio exceeds the level left over starts the
    uncapped ones. The two windows run over one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0))
    free_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * capped) / free_w
    at_cap = F.lit(cap) * F.col("source_size") / F.col("w") <= level
    per = per.withColumn("_level", level).withColumn("_capped", at_cap)
    level_free = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("w"), F.col("_level")).alias("s"))).over(Window.partitionBy(F.lit(1)))
    return per.select("source", "source_size", F.when(F.col("_capped"), F.lit(cap) * F.col("source_size")).otherwise(F.col("w") * level_free["_level"]).cast("double").alias("target"))


def draw(seed: int, *keys: F.Column) -> F.Column:
    """A number in [0, 1) from seed and keys."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def _repeated(c: Carried, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    session(c.rows)
    doc_id, text = F.col(c["doc_id"]), F.col(c["text"])
    sized = sizes(c.rows, c["text"]).withColumn("_place", F.monotonically_increasing_id())
    rates = written(targets(sized.select(F.col(c["source"]).alias("source"), "size"), weights, share, cap), "mix-rates")
    shared = written(c.rows.groupBy(doc_id.alias("_id")).agg(F.count("*").alias("n")).where("n > 1").select("_id", F.lit(True).alias("_shared")), "shared-ids")
    joined = sized.join(rates, F.col(c["source"]).eqNullSafe(F.col("source"))).join(shared, doc_id.eqNullSafe(F.col("_id")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = F.when(F.col("_shared").isNull(), draw(seed, doc_id)).otherwise(draw(seed, doc_id, F.xxhash64(text), F.col("_place")))
    copies = F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*c.own, "size", "source_size", "target", copies.cast("long").alias("copies"))


def repetitions(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the document)."""
    c = Carried(docs.drop(*ADDED))
    return _repeated(c, **options).toDF(*c.names, *ADDED)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: docs' columns, a row for each copy taken."""
    c = Carried(docs)
    taken = _repeated(c, **options).where(F.col("copies") > 0)
    return c.back(taken.select(*c.own, F.explode(F.sequence(F.lit(1), F.col("copies")))))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return repetitions(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM per),
marked AS (SELECT *, 2.0::DOUBLE * source_size / w <= level AS capped FROM levels),
rates AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 2.0::DOUBLE * source_size
              ELSE w * (SELECT level FROM marked WHERE NOT capped ORDER BY source_size / w, source IS NULL, source LIMIT 1) END AS target
  FROM marked)
SELECT doc_id, size, source_size, target,
       (size * (floor(r) + CASE WHEN ('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < r - floor(r) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM (SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r
      FROM sized s JOIN rates t ON s.source IS NOT DISTINCT FROM t.source)
"""
