"""Security analytics on Spark DataFrames."""
