"""Bindings of the engine tables to the driver's parquet tables, and the query catalog."""
