"""Text indexing and distributed data-parallel primitives on PySpark DataFrames."""
