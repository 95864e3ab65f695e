"""Contract-evidence analytics on Spark DataFrames."""
