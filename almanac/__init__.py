"""Point-in-time company fundamentals as Spark DataFrame and Structured Streaming jobs."""
