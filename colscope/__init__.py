"""Dataset profiling and model evaluation on Spark DataFrames."""
