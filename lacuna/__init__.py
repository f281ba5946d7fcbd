"""lacuna: gap-preserving signal and evidence analytics on PySpark DataFrames."""
