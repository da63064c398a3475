"""Column level functions: tile arithmetic, geometry, colours."""
