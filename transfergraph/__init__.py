"""Transfer-graph analytics on Spark: DataFrames in, DataFrames out."""
