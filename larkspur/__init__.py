"""Larkspur: a small, strict SQL engine whose plans are Spark DataFrames."""
