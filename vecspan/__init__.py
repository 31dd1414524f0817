"""vecspan: vector search and vector analytics as plain PySpark DataFrames."""
