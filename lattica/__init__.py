"""Schema-graph analytics on Spark DataFrames."""
