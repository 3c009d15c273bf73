"""What the operators share: the shared folder, written tables, partition counts, Arrow batches."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch sent to Python. Long texts make batches by rows alone too large for a worker.
BATCH_BYTES = 8 << 20


def session(df: DataFrame) -> SparkSession:
    """The session of df, with Arrow batches bounded by bytes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="shared-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run on this machine, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: the operators need a folder that driver and executors share")
    return (at or _own_folder()).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder. Lineage ends there, lost executors cost nothing, and the planner knows the table's size."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size; 0 where it knows none (rows made in the driver)."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 60 else 0


def partitions(df: DataFrame, per: int = 8 << 20, least: int = 16) -> int:
    """A partition count that follows df's size, so that a partition stays near `per` bytes."""
    default = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, default, min(200_000, plan_bytes(df) // per + 1))


class Carried:
    """docs under names of our own (`_0`, `_1`, ...), so that no column of docs clashes with an operator's; back() restores the names."""

    def __init__(self, docs: DataFrame):
        self.names, self.own = docs.columns, [f"_{k}" for k in range(len(docs.columns))]
        self.rows = docs.toDF(*self.own)

    def __getitem__(self, name: str) -> str:
        return self.own[self.names.index(name)]

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.own).toDF(*self.names)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null becomes empty."""
    return [x or "" for x in column(batch, name)]


def batches(rows: Iterator[dict[str, list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for r in rows:
        yield pa.RecordBatch.from_arrays([pa.array(r[f.name], f.type) for f in schema], schema=schema)


class Numbers(dict):
    """Numbers keys as they are first asked for; `new` lists them in that order until it is taken."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def take(self) -> list:
        new, self.new = self.new, []
        return new
