"""Chunked work with a manifest: rows are dealt to chunks once, and each chunk reads and writes its own folder.

Under the path: _source/wave=w/chunk=c, rows as they came, of which a call adds those whose key isn't there yet as a new wave;
wave=w/chunk=c, what work made of them; _manifest, a row for each chunk that is finished, with the rows it read and wrote.
A chunk counts when its row is there, so what a broken run left half done is made again and nothing else is: the next call skips finished
chunks without a look at their rows. New rows are told by an anti-join on keys alone; texts of old rows aren't read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.sources.readers import exists

MANIFEST = "wave int, chunk int, read long, written long"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The finished chunks."""
    return spark.read.schema(MANIFEST).json(f"{path}/_manifest") if exists(spark, f"{path}/_manifest/_SUCCESS") else spark.createDataFrame([], MANIFEST)


def waves(spark: SparkSession, path: str) -> list[int]:
    """The waves that were written whole."""
    out = []
    while exists(spark, f"{path}/_source/wave={len(out)}/_SUCCESS"):
        out.append(len(out))
    return out


def added(df: DataFrame, path: str, key: str, chunks: int) -> None:
    """Rows with new keys, as the next wave. Rows with a null key take no part; of several rows with one key one is taken."""
    spark, known = df.sparkSession, waves(df.sparkSession, path)
    rows = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    if known:
        held = spark.read.schema(df.schema).parquet(*[f"{path}/_source/wave={w}" for w in known]).select(key)
        rows = rows.join(held, key, "left_anti")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))
    dealt.repartition("chunk", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(16))).write.mode("overwrite").option("compression", "zstd").partitionBy("chunk").parquet(f"{path}/_source/wave={len(known)}")


def worked(df: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], chunks: int = 8) -> DataFrame:
    """work on all rows of df that the path doesn't have, chunk by chunk; returns the results of all finished chunks."""
    spark = df.sparkSession
    added(df, path, key, chunks)
    done = {(r.wave, r.chunk) for r in manifest(spark, path).collect()}  # a row a chunk
    for wave in waves(spark, path):
        folder = f"{path}/_source/wave={wave}"
        held = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("chunk", T.IntegerType())])).parquet(folder)  # a wave may be empty
        for chunk in sorted(r.chunk for r in held.select("chunk").distinct().collect()):  # of the folders' names
            if (wave, chunk) in done:
                continue
            rows = spark.read.parquet(f"{folder}/chunk={chunk}")
            target = f"{path}/wave={wave}/chunk={chunk}"
            work(rows).write.mode("overwrite").option("compression", "zstd").parquet(target)
            sizes = rows.count(), spark.read.parquet(target).count()  # of files' footers
            spark.createDataFrame([(wave, chunk, *sizes)], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_manifest")
            done.add((wave, chunk))
    if not done:
        return work(df.limit(0))
    return spark.read.parquet(*[f"{path}/wave={w}/chunk={c}" for w, c in sorted(done)])
