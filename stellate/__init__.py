"""Point-cloud clustering, spatial statistics and corpus operators on Spark DataFrames."""
