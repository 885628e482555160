"""Exact triangle counting on large graphs, and the table jobs around it, as Spark DataFrames."""
