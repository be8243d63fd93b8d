"""Structural, lexical and vector retrieval and ranking on Spark DataFrames."""
