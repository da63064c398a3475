"""Structured Streaming forms of the mergeable raster aggregates."""
