"""One pass over rows to several destinations at once: accepted rows, rejects, folders by split or fold.

A data source writer: each task writes a Parquet file for each destination that its rows name, under a staging folder of the job; when all
tasks are done, the driver moves the files to their folders and marks each folder as whole, and a job that fails leaves no file
in them. Rows are worked out once, and neither persisted nor shuffled. A task holds one row group of BATCH rows for each destination.

Cases: rows whose destination is null go nowhere; a destination is a relative folder, such as accepted or split=train; folders that a job doesn't write to stay
as they are; overwriting replaces the folders that it does write to; a task that runs twice leaves one file, as only the winner's is moved. Files are written through
pyarrow's file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BATCH = 50_000
TO = "_to"


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    """(destination, file under the staging folder) of one task."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        system, root = _system(self.path)
        open_: dict[str, tuple[pq.ParquetWriter, str]] = {}
        held: dict[str, list[pa.Table]] = {}

        def flush(to: str) -> None:
            table = pa.concat_tables(held.pop(to))
            if to not in open_:
                name = f"_staging-{self.job}/{uuid.uuid4().hex}.parquet"
                system.create_dir(f"{root}/_staging-{self.job}", recursive=True)
                open_[to] = pq.ParquetWriter(system.open_output_stream(f"{root}/{name}"), table.schema, compression="zstd"), name
            open_[to][0].write_table(table)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for to in table[TO].unique().to_pylist():
                if to is None:
                    continue
                own = table.filter(pc.equal(table[TO], to)).drop_columns([TO])
                held.setdefault(to, []).append(own)
                if sum(x.num_rows for x in held[to]) >= BATCH:
                    flush(to)
        for to in list(held):
            flush(to)
        for writer, _ in open_.values():
            writer.close()
        return Written([(to, name) for to, (_, name) in open_.items()])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _system(self.path)
        files = [x for m in messages if m for x in m.files]
        for to in sorted({to for to, _ in files}):
            system.create_dir(f"{root}/{to}", recursive=True)
            old = [x.path for x in system.get_file_info(fs.FileSelector(f"{root}/{to}")) if x.type == fs.FileType.File] if self.overwrite else []
            for own, name in files:
                if own == to:
                    system.move(f"{root}/{name}", f"{root}/{to}/part-{name.rsplit('/', 1)[1]}")
            for path in old:
                system.delete_file(path)
            with system.open_output_stream(f"{root}/{to}/_SUCCESS"):
                pass
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing of the staging folder stays."""
        from pyarrow import fs

        system, root = _system(self.path)
        if system.get_file_info(f"{root}/_staging-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_staging-{self.job}")


class Destinations(DataSource):
    @classmethod
    def name(cls) -> str:
        return "destinations"

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def write(df: DataFrame, path: str, to, mode: str = "overwrite") -> None:
    """Rows of df to the folders under path that the column expression `to` names."""
    df.sparkSession.dataSource.register(Destinations)
    df.withColumn(TO, to.cast("string")).write.format("destinations").mode(mode).option("path", path).save()


def accepted_and_rejects(df: DataFrame, path: str, reason: str = "reject_reason") -> None:
    """path/accepted and path/rejects, both with the reason's column."""
    write(df, path, F.when(F.col(reason).isNull(), "accepted").otherwise("rejects"))


def by_folder(df: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """A folder for each value of some columns, as a partitioned table has: path/split=train. The columns stay in the rows too."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in by]
    write(df, path, F.concat_ws("/", *parts))
