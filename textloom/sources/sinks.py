"""Writers: JSON lines, rejects, tables by split, resumable appends, reports and caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.schemas import PREDICTIONS, conform
from textloom.sources import chunks as chunked


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def accepted_and_rejects(df: DataFrame, accepted: str, rejects: str, reason: str = "reject_reason") -> None:
    """Two folders, of rows without and with a reason. The rows are worked out once and kept in between."""
    kept = df.persist()
    try:
        kept.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").json(accepted)
        kept.where(F.col(reason).isNotNull()).write.mode("overwrite").json(rejects)
    finally:
        kept.unpersist()


def audit(df: DataFrame, path: str, columns: tuple[str, ...] = ("language", "source", "was_unwrapped", "n_comments_stripped")) -> None:
    df.select(*columns).write.mode("overwrite").json(path)


def table(df: DataFrame, path: str, by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Parquet with zstd; by: folders, such as split or fold, that later filters prune."""
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def resumed(df: DataFrame, path: str, key: str, work: Callable[[DataFrame], DataFrame], chunks: int = 1) -> DataFrame:
    """Work on the rows whose key isn't there yet, chunk by chunk, and return the results of all: see the module chunks."""
    return chunked.worked(df, path, key, work, chunks)


def cached(df: DataFrame, path: str, code: str, settings: str, work: Callable[[DataFrame], DataFrame], chunks: int = 1) -> DataFrame:
    """work's result per distinct code, kept under the hash of settings and code; known codes aren't worked on again."""
    keyed = df.withColumn("cache_key", F.sha2(F.concat(F.lit(f"{settings}|"), F.col(code)), 256))
    return resumed(keyed, path, "cache_key", work, chunks)


def files(df: DataFrame, path: str, name: str = "name", content: str = "document", each: int | None = None) -> int:
    """A file per row, by the tasks that have the rows, in any file system that pyarrow knows by its address; returns how many. A task that is run again
    writes its files again. each: rows are dealt by name to folders of about so many files, one a task, so that no task has more and tasks don't wait
    for each other in one folder."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path)
        if each:
            root = f"{root}/{TaskContext.get().partitionId():06d}"
        system.create_dir(root, recursive=True)
        for batch in batches:
            for own, text in zip(batch[name].to_pylist(), batch[content].to_pylist()):
                with system.open_output_stream(f"{root}/{own}", compression=None) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    chosen = df.select(name, content)
    if each:
        slots = df.sparkSession.sparkContext.defaultParallelism
        chosen = chosen.repartition(max(2 * slots, -(-df.count() // each)), name)
    return chosen.mapInArrow(rows, "n long").agg(F.sum("n")).first()[0] or 0


def predictions(pairs: DataFrame, path: str) -> DataFrame:
    """A head's scores of pairs (pair_id, language, y, pred, p) as the predictions table, which is returned."""
    both = pairs.select("pair_id", F.col("y").alias("label_true"), F.col("pred").alias("label_pred"), (1 - F.col("p")).alias("prob_same"), F.col("p").alias("prob_A_faster"), "language")
    table(conform(both, PREDICTIONS), path)
    return pairs.sparkSession.read.parquet(path)


def report(df: DataFrame, path: str) -> None:
    """A small table as JSON in one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report as a Markdown table; it comes to the driver, so one of more than `most` rows is refused rather than cut."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows: write a table instead")
    lines = [df.columns, ["---"] * len(df.columns), *([str(x) for x in row] for row in found)]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines)


def log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def manifest(spark, path: str) -> DataFrame:
    """path, bytes, sha256 of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
