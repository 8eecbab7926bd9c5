"""Analytics on time-annotated sessions, as PySpark DataFrame, SQL and Structured Streaming operations."""
