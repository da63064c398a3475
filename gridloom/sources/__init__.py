"""Readers and writers for tiles, raster files and map images."""
