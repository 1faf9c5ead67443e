"""Independent SQL statements of the registered reports, for comparison in DuckDB."""
