"""Road-observation analytics on Spark DataFrames."""
