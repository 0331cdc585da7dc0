"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is
    set only when the session names none and runs in one process, as in tests.  Spark's cleaner
    removes the files once nothing refers to the frame.
    """
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder by columns, which takes less room than :func:`checkpointed`, and read from there."""
    path = f"{fresh_folder(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_folder(spark: SparkSession) -> str:
    """A path that nothing holds yet, in the shared folder; it goes when that folder goes."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kinloom-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()
