"""Product catalogue and price history as Spark DataFrames."""
