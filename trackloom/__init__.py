"""Positional sports tracking analytics and corpus operators on Spark DataFrames."""
