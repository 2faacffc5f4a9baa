"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def cut(df: DataFrame) -> DataFrame:
    """The rows as checkpointed in the folder that the session names. Where it names none, a local session gets a
    temporary one, and any other one is refused: its executors would each write to their own disk."""
    spark = df.sparkSession
    _folder(spark)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The same as compressed columns, for rows that are read more than once; files are left to whoever owns the folder."""
    path = f"{_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get(CHECKPOINT_KEY, None)
        if named is None and context.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="siltworks-"))
    return context.getCheckpointDir()
