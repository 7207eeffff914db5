"""Course-catalog analytics on Spark DataFrames."""
