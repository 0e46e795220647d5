"""hepark.streaming."""
