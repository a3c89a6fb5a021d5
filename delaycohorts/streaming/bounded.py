"""Ingestion in bounded batches: one write per batch holds the cleaned records and all that is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delaycohorts.operators import cleaning as CL
from delaycohorts.streaming.ingest import RAW_SCHEMA


def read_bounded_stream(spark: SparkSession, folder: str, files_per_batch: int, source: Column | None = None) -> DataFrame:
    """CSV files with the raw fields in order, at most ``files_per_batch`` of them in a batch."""
    stream = (
        spark.readStream.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False)
        .option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).csv(folder)
    )
    return stream.withColumn("source_file", F.col("_metadata.file_name") if source is None else source)


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> int:
    """Judges every raw row once and writes it under its source; returns the number of batches run.

    A row is written with its cleaned record, or with null where it is invalid, so counters are read from the
    narrow written columns and the raw text is parsed once. The checkpoint is the resume record, and a batch that is
    replayed overwrites its own folder, so each row counts once, however the files of a source are spread
    over the batches. A run without a new file changes nothing.
    """
    ran: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        ran.append(batch_id)
        CL.judged_flights(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:  # several bounded batches, then it ends by itself
        writer.trigger(availableNow=True).start().awaitTermination()
        return len(ran)
    job = writer.start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    return len(ran)


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """Judged rows of all sources."""
    return spark.read.parquet(target).drop("batch")


def ingested_records(spark: SparkSession, target: str) -> DataFrame:
    return ingested(spark, target).where("record is not null").select("record.*", "source_file")


def ingested_quality(spark: SparkSession, target: str) -> DataFrame:
    """The nine counters per source, from the written rows."""
    return CL.quality_of_judged(ingested(spark, target))
