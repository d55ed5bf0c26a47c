"""Batch auditing of packaged agent skills on Spark DataFrames."""
