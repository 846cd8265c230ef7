"""A deductive query engine over property graphs and tables, on Spark DataFrames."""
