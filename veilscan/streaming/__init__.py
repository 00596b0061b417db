"""Structured Streaming forms of the scan, ingest and alert operators."""
