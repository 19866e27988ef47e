"""Message-stream analytics on Spark: recorded and live publish/subscribe traffic as DataFrames."""
