"""hepark.sources."""
