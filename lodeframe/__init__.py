"""A relational engine and corpus operators on PySpark DataFrames."""
