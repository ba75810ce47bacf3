"""tidemark: point-in-time analytics on Spark DataFrames."""
