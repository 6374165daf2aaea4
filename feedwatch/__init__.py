"""Feed monitoring and notification ranking on Spark DataFrames, MLlib and Structured Streaming."""
