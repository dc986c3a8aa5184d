"""lakeloom: analytics operators woven from Spark DataFrames."""
