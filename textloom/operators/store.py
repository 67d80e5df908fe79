"""Cutting a plan where two later parts must see the very same rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: spark.checkpoint.dir. A local session without it gets a temporary one;
    a cluster needs it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_textloom_folder", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = spark._textloom_folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder, read again: what later jobs read many times, and lost executors read anew."""
    path = f"{checkpoint_folder(df.sparkSession)}/textloom/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
