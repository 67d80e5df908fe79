"""What the operators of this subpackage share: tables in the shared folder, and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session without the setting, whose driver and executors are one process, gets its own temporary folder, once
    per session. On a cluster the setting is needed.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = getattr(spark, "_textloom_shared", None) or "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark._textloom_shared = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/textloom/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of any file system that Spark reads is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def looked_up(rows: DataFrame, key: str, by: str, value: Column, name: str) -> DataFrame:
    """(key, by, name): rows whose key others have too, with an aggregate of their key's rows.

    Keys of more than an even share of the rows are at most as many as there are shares; what each of them aggregates to goes
    to every share, and its rows are dealt out by `by`. The rest meets by key, of which none has more than a share.
    """
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    several = rows.groupBy(key).agg(F.count("*").alias("_n"), value.alias(name)).where("_n > 1")
    most = max(256, rows.count() // shares)
    hot = several.where(F.col("_n") > most).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = rows.select(key, by, F.pmod(F.xxhash64(by), F.lit(shares)).cast("int").alias("_share"))
    dealt = dealt.join(hot.select(key, "_share", name, F.lit(True).alias("_met")), [key, "_share"], "left")
    rest = dealt.where("_met is null").select(key, by).join(several.where(F.col("_n") <= most).select(key, name), key)
    return dealt.where("_met").select(key, by, name).union(rest.select(key, by, name))


def pieces(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of the text column each, and at least one row."""
    column = batch.column(text)
    start, size = 0, 0
    for i, n in enumerate(byte_lengths(column)):
        size += int(n)
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_lengths(column: pa.Array):
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
