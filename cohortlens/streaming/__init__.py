"""Structured Streaming ingestion of arriving raw dumps into the cleaned post table."""

from cohortlens.streaming.ingest import clean_stream, ingest

__all__ = ["clean_stream", "ingest"]
