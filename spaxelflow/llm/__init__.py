"""Training-data operators on Spark DataFrames: one module an operator."""
