"""Streaming ingest of page snapshots."""
