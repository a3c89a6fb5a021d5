"""ZIP archives of monthly CSV files as a Python data source for batches and streams.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("schedule_archives").option("path", folder).load()

An archive holds exactly one CSV file. A ZIP stream cannot be split, so an archive is one partition; it is
opened where it lies and unpacked block by block, so neither the archive nor its file is ever whole in
memory and there is no limit on its size. Empty values are null, every column is text, columns that
are not asked for are not parsed.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from delaycohorts.schema import RAW_FIELDS

NAME = "schedule_archives"
BLOCK_BYTES = 4 << 20
ROWS_PER_ARCHIVE = 500_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a plain path or a URI, and the path in it."""
    plain = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), plain)


@dataclass
class Archive(InputPartition):
    path: str
    modified: int

    def __init__(self, path: str, modified: int) -> None:
        self.path, self.modified = path, modified


def list_archives(folder: str) -> list[Archive]:
    """Archives of the folder by time of change, then by path; a missing folder has none."""
    system, path = file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    own = [f for f in found if f.is_file and f.base_name.lower().endswith(".zip")]
    return [Archive(f.path, f.mtime_ns or 0) for f in sorted(own, key=lambda f: (f.mtime_ns or 0, f.path))]


def read_archive(folder: str, path: str, fields: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Blocks of the wanted columns and ``source_file``, the name of the archive."""
    name = path.rsplit("/", 1)[-1]
    system, _ = file_system(folder)
    with system.open_input_file(path) as stream, zipfile.ZipFile(stream) as archive:
        members = [n for n in archive.namelist() if n.lower().endswith(".csv")]
        if len(members) != 1:
            raise ValueError(f"expected one CSV in {name}, found {len(members)}")
        with archive.open(members[0]) as member:
            line = io.TextIOWrapper(member, "utf-8-sig").readline()
        header = csv.read_csv(io.BytesIO((line.rstrip("\r\n") + "\n").encode())).column_names if line.strip() else []
        missing = sorted(set(fields) - set(header))
        if missing:
            raise ValueError(f"missing columns in {name}: {missing}")
        with archive.open(members[0]) as member:
            blocks = csv.open_csv(
                member, csv.ReadOptions(block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True),
                csv.ConvertOptions(
                    column_types={f: pa.string() for f in fields}, include_columns=list(fields), null_values=[""],
                    strings_can_be_null=True, quoted_strings_can_be_null=True,
                ),
            )
            for block in blocks:
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array([name] * block.num_rows, pa.string())], names=[*fields, "source_file"])


class _Reader(DataSourceReader):
    def __init__(self, folder: str, fields: Sequence[str]) -> None:
        self.folder, self.fields = folder, tuple(fields)

    def partitions(self) -> Sequence[InputPartition]:
        return list_archives(self.folder)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        # an empty folder is read as one partition without a path
        return read_archive(self.folder, partition.path, self.fields) if partition else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the last archive taken, by time of change and path, so that a replayed batch reads the same ones."""

    def __init__(self, folder: str, fields: Sequence[str]) -> None:
        self.folder, self.fields = folder, tuple(fields)

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = list_archives(self.folder)[-1:]
        return {"modified": last[0].modified, "path": last[0].path} if last else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        at = lambda offset: (offset["modified"], offset["path"])
        return [a for a in list_archives(self.folder) if at(start) < (a.modified, a.path) <= at(end)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        return read_archive(self.folder, partition.path, self.fields)


class ArchiveSource(DataSource):
    """Options: ``path``, the folder; ``fields``, the wanted columns joined by commas (all raw fields if unset)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _fields(self) -> list[str]:
        return [f for f in self.options.get("fields", ",".join(RAW_FIELDS)).split(",") if f]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f, T.StringType()) for f in (*self._fields(), "source_file")])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._fields())

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self._fields())


def read_archive_folder(spark: SparkSession, folder: str, fields: Sequence[str] = RAW_FIELDS) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(NAME).option("path", folder).option("fields", ",".join(fields)).load()


def stream_archive_folder(spark: SparkSession, folder: str, fields: Sequence[str] = RAW_FIELDS) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.readStream.format(NAME).option("path", folder).option("fields", ",".join(fields)).load()


def _archive_writer(folder: str, fields: Sequence[str], rows_per_archive: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        held: tuple | None = None  # source, rows so far, number, closers

        def close() -> pa.RecordBatch:
            for c in held[3]:
                c.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{held[0]}~{task}-{held[2]}.zip"]), pa.array([held[1]], pa.int64())], names=["archive", "n_rows"]
            )

        for batch in batches:
            names = batch.column("source_file").to_pylist()
            at = 0
            while at < len(names):
                if held and (held[0] != names[at] or held[1] >= rows_per_archive):
                    yield close()
                    held = (names[at], 0, held[2] + 1 if held[0] == names[at] else 0, ())
                if not held or not held[3]:
                    number = held[2] if held else 0
                    out = system.open_output_stream(f"{base}/{names[at]}~{task}-{number}.zip")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                    member = archive.open(f"{names[at]}.csv", "w", force_zip64=True)
                    member.write((",".join(fields) + "\n").encode())
                    held = (names[at], 0, number, (member, archive, out))
                end = at
                while end < len(names) and names[end] == held[0] and held[1] + end - at < rows_per_archive:
                    end += 1
                rows = pa.Table.from_batches([batch.slice(at, end - at).select(list(fields))])
                csv.write_csv(rows, held[3][0], csv.WriteOptions(include_header=False))
                held = (held[0], held[1] + end - at, held[2], held[3])
                at = end
        if held:
            yield close()

    return write


def write_archives(df: DataFrame, folder: str, fields: Sequence[str] = RAW_FIELDS, rows_per_archive: int = ROWS_PER_ARCHIVE) -> DataFrame:
    """Rows as ZIP archives ``<source_file>~<task>-<number>.zip``; one row per archive, to be written or counted.

    A source is spread over all tasks by the hash of its rows, so a large month is many archives. Rows and
    names follow from the data alone, so a task that runs again replaces its own files by equal ones. Null
    and empty values are the same in the files.
    """
    spread = df.select(*fields, "source_file").repartition("source_file", F.pmod(F.xxhash64(*fields), F.lit(16)))
    return spread.sortWithinPartitions("source_file", *fields).mapInArrow(
        _archive_writer(folder, tuple(fields), rows_per_archive), "archive string, n_rows bigint"
    )
