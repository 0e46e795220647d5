"""hepark.plans."""
