"""File sources and Parquet sinks."""
