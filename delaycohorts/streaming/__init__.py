"""Incremental ingestion with Structured Streaming."""

from delaycohorts.streaming.ingest import ingest_incremental

__all__ = ["ingest_incremental"]
