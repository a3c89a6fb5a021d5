"""File sources and sinks: raw CSV, archives, study rows, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delaycohorts.schema import RAW_FIELDS

CHUNK_ROWS = 20_000


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Fail at plan time with the sorted missing names."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_raw(spark: SparkSession, paths: str | list[str], required: Iterable[str] = RAW_FIELDS) -> DataFrame:
    """Monthly CSV files with every column as text plus ``source_file``.

    Every file is read by its own header: files with equal headers are one scan, and the scans are
    united by column name. A required column that any file lacks is an error.
    """
    plain = spark.read.option("header", True).option("inferSchema", False)
    groups: dict[tuple[str, ...], list[str]] = {}
    for file in sorted(plain.csv(paths).inputFiles()):
        groups.setdefault(tuple(plain.csv(file).columns), []).append(file)
    if not groups:
        return require_columns(plain.csv(paths), required).withColumn("source_file", F.col("_metadata.file_name"))
    parts = []
    for header, files in groups.items():
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(files)
        parts.append(require_columns(part, required).withColumn("source_file", F.col("_metadata.file_name")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _archive_rows(fields: tuple[str, ...]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                name = path.rsplit("/", 1)[-1]
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    members = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError(f"expected one CSV in {name}, found {len(members)}")
                    with archive.open(members[0]) as stream:
                        chunks = pd.read_csv(
                            stream, dtype=str, keep_default_na=False, na_values=[""],
                            chunksize=CHUNK_ROWS, encoding="utf-8-sig",
                        )
                        for chunk in chunks:
                            missing = sorted(set(fields) - set(chunk.columns))
                            if missing:
                                raise ValueError(f"missing columns in {name}: {missing}")
                            yield chunk[list(fields)].assign(source_file=name)

    return rows


def read_archives(spark: SparkSession, glob: str, fields: tuple[str, ...] = RAW_FIELDS) -> DataFrame:
    """ZIP archives holding exactly one CSV each; unpacked in chunks, one archive per record.

    A ZIP stream cannot be split, so the archive is the unit of parallelism (a month here).
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in (*fields, "source_file")])
    blobs = spark.read.format("binaryFile").load(glob).select("path", "content")
    return blobs.mapInPandas(_archive_rows(tuple(fields)), schema)


STUDY_SCHEMA = "flight_number string, flight_date string, airline string, manually_confirmed boolean, confirmation_source string"


def read_study_rows(spark: SparkSession, path: str) -> DataFrame:
    """Planned lookups from a JSON array file."""
    return spark.read.schema(STUDY_SCHEMA).json(path, multiLine=True)


def write_report(df: DataFrame, path: str) -> None:
    """Tidy metric rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def _write_counted(df: DataFrame, path: str) -> int:
    """Writes and returns the number of rows, counted by the tasks that write them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get["rows"]


def checked_layout(spark: SparkSession, path: str, rows: int, schema: T.StructType) -> DataFrame:
    """The files of a layout; an error if their footers do not add up to the rows that were written."""
    df = spark.read.schema(schema).parquet(path)
    found = df.count()
    if found != rows:
        raise RuntimeError(f"row-count mismatch: written={rows}, found={found}")
    return df


def write_serving(df: DataFrame, path: str) -> int:
    """Narrow file sorted so that carrier and date filters skip row groups; returns the rows written."""
    return _write_counted(
        df.repartitionByRange("reporting_carrier", "origin", "flight_date")
        .sortWithinPartitions("reporting_carrier", "origin", "destination", "flight_date"), path,
    )


def write_schedule(df: DataFrame, path: str) -> int:
    """Schedule facts range-sorted by the lookup key; returns the rows written."""
    key = ("reporting_carrier", "flight_date", "flight_number")
    return _write_counted(df.repartitionByRange(*key).sortWithinPartitions(*key, "crs_departure_minutes"), path)
