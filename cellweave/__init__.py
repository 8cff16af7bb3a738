"""cellweave: 2D range-sensor mapping on Spark DataFrames."""
