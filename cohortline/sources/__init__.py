"""Delimited and Parquet inputs, delimited outputs."""
