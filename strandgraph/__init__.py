"""Research-lineage analytics on Spark DataFrames."""
