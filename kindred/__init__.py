"""kindred: similarity search and dataset deduplication on PySpark DataFrames."""
