"""The map-algebra formula language and its compilation to Columns."""
