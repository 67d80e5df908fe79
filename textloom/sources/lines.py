"""JSON lines in the order of their files: a data source whose partitions are byte ranges of files.

A row carries the number of its file (files go by name, then folder) and the byte at which its line begins, as two longs, so (file, at) is an
order over all rows that costs 16 bytes, whatever the paths. A line belongs to the range that it begins in, so ranges can be cut
anywhere and read in any order. Python only cuts lines out of bytes, in Arrow batches; they are parsed in the JVM.

Cases: blank lines are no rows; a last line may lack its end; lines end with a line feed, with or without a carriage return before it; bytes that aren't UTF-8 are
replaced; a line that doesn't fit the schema is kept in _bad with a reason; no files give no rows. Files are found and read through
pyarrow's file systems.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and lines of a batch.
RANGE, LINES = 64 << 20, 8192
COLUMNS = "file long, at long, value string"


def found(path: str) -> Iterator[tuple[str, str, int]]:
    """(name, address, bytes) of the files under a folder, or of a file; hidden ones and markers are left out."""
    from pyarrow import fs

    address = path if "://" in path or path.startswith("file:") else f"file://{path}"
    system, root = fs.FileSystem.from_uri(address)
    scheme = address.split(":", 1)[0]
    info = system.get_file_info(root)
    files = system.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
    for x in files:
        below = x.path[len(root) :].split("/")
        if x.type == fs.FileType.File and not any(part.startswith(("_", ".")) for part in below):
            yield x.base_name, f"{scheme}://{x.path}", x.size


def lines(raw, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at start or later and before end."""
    source, at = io.BufferedReader(raw, 1 << 20), 0
    if start:
        source.seek(start - 1)
        at = start - 1 + len(source.readline())
    while at < end and (line := source.readline()):
        yield at, line
        at += len(line)


@dataclass
class Range(InputPartition):
    file: int
    address: str
    start: int
    end: int


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Range]:
        files = sorted({(name, address, size) for path in self.paths for name, address, size in found(path)})
        return [Range(i, address, a, min(size, a + self.size)) for i, (_, address, size) in enumerate(files) for a in range(0, size, self.size)] or [Range(-1, "", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if part.file < 0:
            return
        system, place = fs.FileSystem.from_uri(part.address)
        kinds = pa.schema([("file", pa.int64()), ("at", pa.int64()), ("value", pa.string())])
        places, texts = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.file] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=kinds)

        with system.open_input_file(place) as raw:
            for at, line in lines(raw, part.start, part.end):
                text = line.rstrip(b"\r\n")
                if text.strip():
                    places.append(at)
                    texts.append(text.decode(errors="replace"))
                if len(places) == LINES:
                    yield batch()
                    places, texts = [], []
        if places:
            yield batch()


class OrderedLines(DataSource):
    """Options: paths (a JSON list of files and folders) and range (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(json.loads(self.options["paths"]), int(self.options.get("range", RANGE)))


def raw(spark: SparkSession, paths: list[str] | str, size: int = RANGE) -> DataFrame:
    """file, at, value of all lines."""
    spark.dataSource.register(OrderedLines)
    return spark.read.format("ordered_lines").option("paths", json.dumps([paths] if isinstance(paths, str) else paths)).option("range", size).load()


def jsonl(spark: SparkSession, paths: list[str] | str, schema: T.StructType, size: int = RANGE) -> DataFrame:
    """file, at, the schema's fields, _bad (a line that doesn't fit) and reason."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = raw(spark, paths, size).withColumn("row", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    whole = F.get_json_object("value", "$")
    reason = F.when(F.col("row._bad").isNull(), F.lit(None)).when(whole.isNull(), "not JSON").when(~F.startswith(F.ltrim(whole), F.lit("{")), "not an object").otherwise("a field of another type")
    return rows.select("file", "at", *[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields], "row._bad", reason.alias("reason"))
