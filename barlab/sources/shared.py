"""The folder that a cluster shares, for intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of our own only in local mode, where executors see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="barlab-"))
    return _OWN[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """A table that is read more than once, written to the shared folder and read back; its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/barlab/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
