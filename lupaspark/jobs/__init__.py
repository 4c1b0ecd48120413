"""Published jobs: operators composed over domain tables. Each takes DataFrames and gives DataFrames; the queries in plans feed them from the given tables."""
