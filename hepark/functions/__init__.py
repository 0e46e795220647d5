"""hepark.functions."""
