"""Contract-driven alignment-data processing on Spark DataFrames."""
