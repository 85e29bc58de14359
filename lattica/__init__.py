"""Mesh and field analytics on Spark DataFrames."""
