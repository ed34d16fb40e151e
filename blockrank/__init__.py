"""blockrank: hybrid retrieval over collections of linked notes, on Spark DataFrames."""
