"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's URI in spark.checkpoint.dir; in a local temporary folder only where that is unset, as on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set: this needs a folder that driver and executors share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix=f"{label}-")
