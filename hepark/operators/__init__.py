"""hepark.operators."""
