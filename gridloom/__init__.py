"""Analytics for large gridded spatial data on Spark DataFrames."""
