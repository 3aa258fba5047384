"""A small relational SQL dialect with first-class vectors, on Spark DataFrames."""
