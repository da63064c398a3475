"""Raster operators: joins, aggregation, algebra, tiling, rendering."""
