"""querent: column metadata, schema linking and SQL answer selection on Spark DataFrames."""
