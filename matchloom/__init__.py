"""Record linkage and pair analytics on Spark DataFrames."""
