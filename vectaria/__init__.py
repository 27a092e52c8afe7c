"""A retrieval engine on Spark DataFrames."""
