"""Point clouds and Gaussian splats as Spark DataFrames."""
