"""Market-event analytics on Spark DataFrames."""
