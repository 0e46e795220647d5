"""Two-class event analytics on Spark DataFrames.

Every operator takes and returns DataFrames; the driver only ever holds
parameters (scaler rows, model weights, bucket boundaries) whose size is
bounded by the number of features, not by the number of rows.
"""

__version__ = "0.1.0"
