"""Information-theoretic field analytics on Spark DataFrames."""
