"""Incremental ingest of landed read files."""
