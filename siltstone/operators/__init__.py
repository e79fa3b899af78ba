"""Data-processing operators built on DataFrames."""
