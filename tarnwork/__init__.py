"""Analytics of molecular water networks on Spark DataFrames."""
