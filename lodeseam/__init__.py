"""Code and document retrieval on Spark DataFrames."""
