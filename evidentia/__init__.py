"""Evidence-first analytics on PySpark DataFrames."""
