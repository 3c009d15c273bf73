"""A training-data pipeline over `documents`: each stage works on all rows its predecessor kept.

1. language: documents whose language the classifier rejects go.
2. near_duplicates: of each SimHash component the document of the smallest doc_id stays.
3. pii: personal data in texts is masked.
4. mix: sources are mixed to their target weights; a document may be taken not at all, once or twice.
5. tokens: texts become byte-level BPE ids; a row for each document taken: doc_id, n_tokens, ids_sha256, decoded_sha256.

Each stage's rows are written to the shared folder as Parquet and read again. Columns that documents has beyond its own pass through all stages
but the last; what the operators add has names that can't clash with them.

Nulls: documents with a null text, or one without letters, are rejected by the first stage; a null doc_id, source or lang is kept, and a null source is a
source of its own. Empty texts go with the first stage, very long ones are read whole. Of repeated rows one stays (they are near duplicates);
ties go to the smallest doc_id, then to the row written first. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylog.llm import bpe, language, mixing, pii, simhash
from quarrylog.llm.common import new_path


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("pii", stage_pii),
    ("mix", stage_mix),
    ("tokens", stage_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: SQL expresses neither the fingerprints nor the encoding; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None
