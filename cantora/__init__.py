"""Note-stream analytics on Spark: operators as DataFrame transforms over many recordings at once."""
