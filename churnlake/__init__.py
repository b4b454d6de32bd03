"""Customer-retention analytics on Spark DataFrames."""
