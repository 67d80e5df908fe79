"""Incremental runs: new files of JSON lines, labelled and exactly deduplicated as they come.

A stream reads each file once (its checkpoint knows which), so a restart goes on where it was. The first row of a code wins
within the watermark; what is kept forever is in the written table, which a batch deduplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.labels import label_of
from textloom.schemas import RAW


def records(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Raw records of files that arrive in a folder, with the time of their file."""
    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_at_once).json(folder)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("seen"))


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", label_of(F.coalesce(F.nullif("pre_label", F.lit("")), F.col("raw_complexity")))).withColumn("code_sha256", F.sha2("code", 256))


def first_seen(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """One row per language, label and code within the watermark."""
    return rows.withWatermark("seen", late).dropDuplicatesWithinWatermark(["language", "label", "code_sha256"])


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, late: str = "1 day"):
    """Append all files that are there now to a table, then stop."""
    stream = first_seen(labelled(records(spark, folder)), late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start()
