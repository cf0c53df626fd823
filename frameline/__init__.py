"""Frame-timeline analytics on Spark DataFrames."""
