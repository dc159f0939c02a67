"""Market-style event data on Spark."""
