"""Column functions with spreadsheet semantics, all built from Spark's own."""
