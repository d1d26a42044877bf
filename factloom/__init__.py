"""factloom: code-fact indexing and lookup on Spark DataFrames."""
