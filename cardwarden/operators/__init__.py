"""DataFrame operators. Each takes and returns DataFrames, and builds on Spark's own plans."""
