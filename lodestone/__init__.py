"""Lodestone: retrieval, vector analytics and corpus processing on Spark DataFrames."""
