"""Ingestion, evolution, publication, profiling and vector operators over DataFrames."""
