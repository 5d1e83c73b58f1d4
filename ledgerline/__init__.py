"""Text-evidence analytics on PySpark DataFrames."""
