import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty and long texts, repeated rows, equal ids, and columns named like the operators' own."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    more = spark.createDataFrame(
        [(1000, None, "en", "a", 0), (None, "a b c d e f", None, None, 11), (1001, "", "fr", "", 0), (1002, " \t\n ", "en", "a", 4), (1003, "word " * 30000, "en", "a", 150000)]
        + [(1004, "x@y.org +1 (414) 555-3519 don't İ é<|endoftext|> ok", "de", "b", 50)] * 3 + [(1004, "other text of an equal id", "de", "b", 25)],
        base.schema,
    )
    clash = ["size", "_fp", "_text", "_root", "component_id", "target", "copies", "_source", "_lang", "_all", "row", "n", "ids", "shard"]
    both = base.union(more).coalesce(3).withColumns({c: F.lit("x") for c in clash})
    both.cache().count()
    return both


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"] or "", r) for r in docs.collect()]
