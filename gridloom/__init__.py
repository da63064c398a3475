"""Raster analytics and corpus preparation expressed as Spark DataFrame jobs."""
